import random
from decimal import ROUND_HALF_UP, Decimal

from conftest import rows

from cashtide.operators.allocate import allocate_exact, even_split, split_by_share


def test_parts_add_up_to_the_cent(spark):
    rng = random.Random(23)
    data, totals = [], []
    for group in range(60):
        totals.append((group, Decimal(rng.randrange(-(10**9), 10**11)) / 100))
        size = 500 if group == 0 else rng.randrange(1, 9)
        data += [(group, key, Decimal(rng.randrange(1, 10**7)) / 100) for key in rng.sample(range(10**6), size)]
    got = allocate_exact(
        spark.createDataFrame(data, "g int, k int, w decimal(12,2)"),
        spark.createDataFrame(totals, "g int, total decimal(28,2)"),
        "total", "w", ["g"], "k",
    ).collect()
    assert len(got) == len(data)
    for group, total in totals:
        parts = sorted((r.k, r.w, r.allocated) for r in got if r.g == group)
        assert sum(p[2] for p in parts) == total
        whole = sum(p[1] for p in parts)
        for _, weight, part in parts[:-1]:
            assert part == (total * weight / whole).quantize(Decimal("0.01"), ROUND_HALF_UP)


def test_one_row_takes_all_and_the_last_takes_the_rest(spark):
    rows_ = spark.createDataFrame([("a", 1, Decimal(5)), ("b", 1, Decimal(1)), ("b", 2, Decimal(1)), ("b", 3, Decimal(1))], "g string, k int, w decimal(12,2)")
    totals = spark.createDataFrame([("a", Decimal("9.99")), ("b", Decimal("100.00"))], "g string, t decimal(12,2)")
    got = {(r.g, r.k): str(r.allocated) for r in allocate_exact(rows_, totals, "t", "w", ["g"], "k").collect()}
    assert got == {("a", 1): "9.99", ("b", 1): "33.33", ("b", 2): "33.33", ("b", 3): "33.34"}


def test_no_weight_leaves_the_total_with_the_last_row(spark):
    rows_ = spark.createDataFrame([("a", 1, Decimal(0)), ("a", 2, Decimal(0))], "g string, k int, w decimal(12,2)")
    totals = spark.createDataFrame([("a", Decimal("5.00"))], "g string, t decimal(12,2)")
    got = {r.k: r.allocated for r in allocate_exact(rows_, totals, "t", "w", ["g"], "k").collect()}
    assert got == {1: Decimal(0), 2: Decimal("5.00")}


def test_a_group_without_a_name_takes_part(spark):
    rows_ = spark.createDataFrame([(None, 1, Decimal(1)), (None, 2, Decimal(3)), ("a", 1, Decimal(1))], "g string, k int, w decimal(12,2)")
    totals = spark.createDataFrame([(None, Decimal("8.00")), ("a", Decimal("1.00"))], "g string, t decimal(12,2)")
    got = {(r.g, r.k): int(r.allocated) for r in allocate_exact(rows_, totals, "t", "w", ["g"], "k").collect()}
    assert got == {(None, 1): 2, (None, 2): 6, ("a", 1): 1}


def test_even_split(spark):
    sizes = {None: (4, 6), "few": (3, 2), "same": (4, 4), "rest": (3, 11), "hot": (200, 1234), "none": (2, 0)}
    data = [(g, key) for g, (n, _) in sizes.items() for key in range(10, 10 + n)]
    totals = spark.createDataFrame([(g, t) for g, (_, t) in sizes.items()], "g string, t bigint")
    got = even_split(spark.createDataFrame(data, "g string, k int"), totals, "t", ["g"], "k", slices=6).collect()
    for g, (n, total) in sizes.items():
        units = [u for _, u in sorted((r.k, r.units) for r in got if r.g == g)]
        assert units == [total // n + (1 if place < total % n else 0) for place in range(n)]


def test_split_by_share(spark):
    df = spark.createDataFrame([("d", Decimal("10.01"))], "day string, v decimal(12,2)")
    got = split_by_share(df, "v", {"a": "0.74", "b": "0.26"}, "part", "who")
    assert sorted(rows(got)) == [("d", "a", Decimal("7.41")), ("d", "b", Decimal("2.60"))]
