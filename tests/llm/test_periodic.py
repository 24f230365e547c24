import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from cashtide.llm.periodic import periodic_runs, run_digest
from cashtide.llm.queries import op13_periodic_runs

BLANK = b" \t\n\x0b\x0c\r"


def brute(words, least=6, times=4):
    """Every run as (start, length, smallest period), by comparing all words q apart for each q."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and words:
        n = len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
    )


def test_the_query_equals_brute_force(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    got = sorted(tuple(r) for r in op13_periodic_runs(spark, sample).collect())
    want = sorted(expected(r["doc_id"], r["text"]) for r in docs.collect())
    assert got == want
    assert sum(r[1] > 0 for r in got) > 10


def texts():
    draw = random.Random(4)
    for n in (0, 1, 5, 6, 7, 8, 40, 300, 2000):
        for kinds in (1, 2, 3, 30):
            words = [f"w{draw.randrange(kinds)}" for _ in range(n)]
            if n > 8:
                a = draw.randrange(n // 2)
                p = 1 + (n - a) // draw.randint(3, 9)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            yield draw.choice([" ", "\n", "\t \r"]).join(words)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (10, 3)])
def test_all_runs_with_their_smallest_periods(spark, least, times):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in periodic_runs(docs, least=least, times=times).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = text.encode().split()
        runs = brute(words, least, times)
        assert [tuple(r) for r in got[doc_id]["runs"]] == sorted(runs, key=lambda r: (r[0], r[2]))
        assert got[doc_id]["collapsed"] == collapsed(words, runs)
        assert got[doc_id]["n_words"] == len(words)


def test_awkward_rows(spark, awkward):
    long = "ä" + " same" * 300_000
    found = periodic_runs(awkward([(1, None), (1, ""), (None, "a a a a a a"), (2, long), (2, " \x0b\n")])).collect()
    by_text = sorted((r["doc_id"] or 0, r["n_words"], len(r["runs"]), r["collapsed"]) for r in found)
    assert by_text == [(0, 6, 1, "a"), (1, 0, 0, ""), (1, 0, 0, ""), (2, 0, 0, ""), (2, 300_001, 1, "ä same")]
    assert run_digest(periodic_runs(awkward([]))).count() == 0


def test_of_equal_exponents_the_first_run_counts(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b x c d c d c d c d"), (2, "a a a a a a b c b c b c b c b c")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in run_digest(periodic_runs(docs)).collect()}
    assert got == {1: (2, 0, 8, 2, 4000), 2: (2, 0, 6, 1, 6000)}


def test_a_run_needs_two_periods(spark, awkward):
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs(awkward([]), times=1)
