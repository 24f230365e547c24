import hashlib
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cashtide.llm import bpe, packing
from cashtide.llm.common import table
from cashtide.llm.transducer import TokenCounter, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "s", "S", "İ", "Σ", "'", "'s", "'LL", "'ll", "'re", " ", "  ", "\n", "\t", " ", "é", "é", "ß", "1", "23", "½", "!", "?!"]
PARTS += ["<|endoftext|>", "<|startoftext|>", "the", " don't", "日本", "😀", "́", "\x1c", "\x85", "​", "ing", " ción", "...", "ǅ", "'t", "' t", "　"]


def texts(n, seed=3):
    draw = random.Random(seed)
    found = ["".join(draw.choices(PARTS, k=draw.randint(0, 30))) for _ in range(n)]
    return [*found, "", "\n", " ", "a" * 3000, " " * 2000, "ab" * 2000, "!" * 300]


def test_counts_match_library():
    library = Tokenizer.from_file(BYTES)
    some = texts(2500)
    expected = [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert TokenCounter(BYTES).counts(some).tolist() == expected


def test_given_documents_match_library(spark):
    """Counts, ids and decoded texts of every document are the library's."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    given = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    by_bytes, by_words = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    counted = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, BYTES).collect()}
    assert counted == {i: (len(t.encode()), len(by_bytes.encode(t, add_special_tokens=False).ids)) for i, t in given.items()}
    expected = {}
    for i, t in given.items():
        ids = by_words.encode(t, add_special_tokens=False).ids
        expected[i] = (len(ids), sha(" ".join(map(str, ids))), sha(by_words.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, WORDS).collect()} == expected


def test_chunks_compose_to_the_same_words():
    from cashtide.llm.transducer import Cutter

    library = Tokenizer.from_file(BYTES)
    some = texts(200, 9)
    for chunk in (1, 3, 1000):
        buf, starts, lens, numbers = Cutter(library.pre_tokenizer, chunk).words(some)
        data = buf.tobytes()
        for i, t in enumerate(some):
            words = [data[starts[k] : starts[k] + lens[k]].decode() for k in range(numbers[i], numbers[i + 1])]
            assert words == [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]


def test_counting_awkward_rows(awkward):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 50_000)]
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(awkward(rows), BYTES).collect())
    assert found == [(0, 1, 1, False), (1, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False), (3, 3, 2, False), (4, 250_000, 50_001, True)]
    assert token_counts(awkward([]), BYTES).count() == 0


def test_ids_match_library():
    library = Tokenizer.from_file(BYTES)
    some = texts(1500, 4)
    expected = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in packing.TokenIds(BYTES).of(some)] == expected


def test_word_bpe_matches_library():
    library, coder = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    for t in texts(2500, 5):
        ids = library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids, t
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_short_and_long_merges_agree():
    coder = bpe.WordBpe(WORDS)
    draw = random.Random(1)
    for _ in range(300):
        symbols = [coder._ids[c] for c in draw.choices("aeinrst", k=draw.randint(1, 60))]
        assert coder._merges._short(symbols.copy()) == coder._merges._long(symbols.copy())


def test_round_trip_of_awkward_rows(awkward):
    library = Tokenizer.from_file(WORDS)
    rows = [(1, None), (2, ""), (3, "Hello, World"), (3, "Hello, World"), (None, "x"), (4, "word " * 20_000)]
    found = bpe.round_trip(awkward(rows), WORDS).collect()
    assert len(found) == len(rows)
    for r in found:
        t = dict(rows)[r.doc_id] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.decode(bpe.encode(awkward(rows), WORDS), WORDS).collect()
    assert {r.doc_id: r.decoded for r in both}[3] == library.decode(library.encode("Hello, World").ids, skip_special_tokens=False)
    assert bpe.round_trip(awkward([]), WORDS).count() == 0 and bpe.encode(awkward([]), WORDS).count() == 0


def packed(rows, library, tokens=1024, segments=128):
    """Check that each document's ids are covered, and return sequences as lists of pieces."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        total = sum(p.length for p in pieces)
        assert total == tokens or total & (total - 1) == 0
        assert total <= tokens and len(pieces) <= segments
    return sequences


def test_packing_covers_all_ids(spark, sample):
    docs = table(spark, sample, "documents")
    library = Tokenizer.from_file(BYTES)
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = packing.pack(docs.repartition(3), BYTES).collect()
    packed(rows, library)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda p: p.start)
        at = 0
        for p in pieces:
            part = ids[i][p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += p.length
        assert at == len(ids[i])


def test_packing_limits(awkward, spark):
    rows = [(i, "a b c d e " * (i % 9)) for i in range(120)] + [(None, None), (7, ""), (7, "")]
    docs = awkward(rows).coalesce(2)
    found = packing.pack(docs, BYTES, tokens=64, segments=4, loss=40, width=5, with_ids=True).collect()
    for pieces in packed(found, None, 64, 4).values():
        assert sum(max(0, p.length - 1) for p in pieces) <= 40
        assert all(len(p.ids) == p.length for p in pieces)
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
    assert packing.pack(awkward([]), BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, BYTES, tokens=1000)


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(i, "one two three four five six", 4, "x") for i in range(40)], "doc_id long, text string, plain long, ids string").coalesce(1)
    found = packing.pack(docs, BYTES, prompt="plain", tokens=32, loss=6).collect()
    for pieces in packed(found, None, 32).values():
        assert sum(max(0, p.length - max(1, 4 - p.start)) for p in pieces) <= 6
