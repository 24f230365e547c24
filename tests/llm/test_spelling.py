import random
import re
import zlib
from collections import Counter

import pytest

from cashtide.llm import spelling
from cashtide.llm.queries import op11_spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keys(word):
    """What two words one edit apart share: the word with one character left out, or blanked, and the word itself."""
    yield word
    for k in range(len(word)):
        yield word[:k] + word[k + 1 :]
        yield word[:k] + "\0" + word[k + 1 :]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, times=10):
    shared = {}
    for word in counts:
        for key in set(keys(word)):
            shared.setdefault(key, []).append(word)
    near = {word: set() for word in counts}
    for word in counts:
        for key in keys(word):
            near[word].update(w for w in shared[key] if one_edit(word, w))
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= times * n else None
    rows = []
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        rows.append((word, form[word], root, n, len(near[word]), counts[form[word]] if form[word] else None))
    return sorted(rows)


def counted(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            word = run.translate(FOLD)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def test_the_query_equals_brute_force(spark, sample):
    docs = [tuple(r) for r in spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(counted(docs))
    got = sorted(tuple(r) for r in op11_spelling_variants(spark, sample).collect())
    assert got == want
    assert sum(r[1] is not None for r in got) >= 5


def vocabulary():
    draw = random.Random(9)
    out = {}
    for letters, size in (("ab", 9), ("acgt", 70), ("abcdefghijklmnoé", 8), ("xyzß", 300)):
        for _ in range(25):
            word = "".join(draw.choice(letters) for _ in range(size))
            out[word] = draw.choice([1, 5, 100, 10_000])
            for _ in range(4):
                k = draw.randrange(size)
                out.setdefault(draw.choice([word[:k] + word[k + 1 :], word[:k] + draw.choice(letters) + word[k:], word[:k] + "q" + word[k + 1 :]]), draw.choice([1, 9, 50]))
    return out


@pytest.mark.parametrize(("sample_size", "cell"), [(100_000, 2048), (100_000, 16), (60, 16)])
def test_variants_do_not_depend_on_the_cells(spark, sample_size, cell):
    """Cells from a small sample, lengths without a sampled word, and cells with more equal vectors than they should hold."""
    counts = vocabulary()
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = sorted(tuple(r) for r in spelling.variants(words, sample=sample_size, cell=cell).collect())
    assert got == brute(counts)


def test_chains_of_forms(spark):
    counts = {"abcdefg" + "x" * k: 3 * 11**k for k in range(7)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(words).collect()}
    last = "abcdefg" + "x" * 6
    assert all(got[w][1] == last for w in counts)
    assert got[last][0] is None


def test_equal_vectors_are_cut_into_parts():
    """Words of one letter bag cannot be split by their counts."""
    draw = random.Random(2)
    words = sorted({"".join(draw.sample("abcdefgh", 8)) for _ in range(300)})
    tree = spelling.Tree.build(spelling.vectors(words), 50, keep=False)
    assert tree.leaves == 1
    assert tree.high[0] == -(-len(words) // 50)


def test_awkward_rows(spark, awkward):
    texts = [(1, None), (1, ""), (None, "Variant variant variänt"), (2, "7variant_variant " * 50_000), (2, "short wörds × ÷")]
    got = sorted(tuple(r) for r in spelling.spelling_variants(awkward(texts)).collect())
    # The long text's words, and the two of the row without an id.
    assert got == [("variant", None, "variant", 100_002, 0, None)]
    assert spelling.spelling_variants(awkward([])).count() == 0
    nothing = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(nothing).count() == 0


def test_names_of_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(5, "wordings wordings", "x", 1, 2)], "id int, body string, word string, n int, h int")
    assert [r["word"] for r in spelling.spelling_variants(docs, "id", "body").collect()] == ["wordings"]
