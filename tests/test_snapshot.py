import datetime as dt
import random
from decimal import Decimal

import pytest
from conftest import day

from cashtide.operators.snapshot import inventory_snapshot, valued_snapshot

WEEKS = [day("2026-10-24"), day("2026-10-31")]


def snapshot(spark, data, weeks=WEEKS, sold=None):
    schema = "product_id int, store_id int, {} date, units int"
    receipts = spark.createDataFrame([(p, s, day(d), u) for p, s, d, u in data], schema.format("receipt_date"))
    if sold is not None:
        sold = spark.createDataFrame([(p, s, day(d), u) for p, s, d, u in sold], schema.format("date_key"))
    return inventory_snapshot(receipts, weeks, sold=sold)


def test_a_receipt_counts_from_its_week_on(spark):
    data = [(1, 1, "2024-05-25", 5), (1, 1, "2026-10-31", 2), (2, 1, "2026-11-01", 9)]
    got = {(r.week_ending_date, r.product_id): (r.on_hand_units, r.last_receipt_date) for r in snapshot(spark, data).collect()}
    assert got == {(WEEKS[0], 1): (5, day("2024-05-25")), (WEEKS[1], 1): (7, day("2026-10-31"))}


@pytest.mark.parametrize("count", [3, 60])
def test_stock_against_brute_force(spark, count):
    weeks = [day("2026-01-03") + dt.timedelta(weeks=n) for n in range(count)]
    rng = random.Random(count)

    def moves(n):
        return [(rng.randrange(3), rng.randrange(2), str(weeks[0] + dt.timedelta(days=rng.randrange(-900, 430))), rng.randrange(1, 9)) for _ in range(n)]

    data, sold = moves(150), moves(90)
    want = {}
    for week in weeks:
        for key in {(p, s) for p, s, _, _ in data}:
            received = [(day(d), u) for p, s, d, u in data if (p, s) == key and day(d) <= week]
            gone = sum(u for p, s, d, u in sold if (p, s) == key and day(d) <= week)
            held = sum(u for _, u in received) - gone
            if received and held > 0:
                want[week, *key] = (held, max(received)[0])
    got = {(r.week_ending_date, r.product_id, r.store_id): (r.on_hand_units, r.last_receipt_date) for r in snapshot(spark, data, weeks, sold).collect()}
    assert got == want


def test_value_age_and_markdown(spark):
    products = spark.createDataFrame([(1, Decimal("2.50"))], "product_id int, unit_cost decimal(10,2)")
    ages = {30: "0-30", 31: "31-60", 60: "31-60", 61: "61-90", 90: "61-90", 91: "90+"}
    data = [(1, age, str(WEEKS[1] - dt.timedelta(days=age)), 3) for age in ages]
    got = {r.store_id: r for r in valued_snapshot(snapshot(spark, data, WEEKS[1:]), products).collect()}
    assert {age: r.aging_bucket for age, r in got.items()} == ages
    assert {age for age, r in got.items() if r.is_aged} == {91}
    assert all(r.on_hand_cost == Decimal("7.50") and r.days_on_hand == age for age, r in got.items())
    # 45% of 7.50 and 5% of 7.50, halves up.
    assert got[91].markdown_liability_amt == Decimal("3.38")
    assert got[30].markdown_liability_amt == Decimal("0.38")


def test_cost_of_an_unknown_product_is_unknown(spark):
    products = spark.createDataFrame([(5, Decimal("2.50"))], "product_id int, unit_cost decimal(10,2)")
    got = valued_snapshot(snapshot(spark, [(1, 1, "2026-10-30", 3)]), products).collect()
    assert [(r.on_hand_units, r.on_hand_cost) for r in got] == [(3, None)]


def test_stock_worked_out_once_is_the_stock_of_each_week(spark):
    """What one model reads for a week, alone or with others, is what it works out for that week."""
    from cashtide import queries
    from cashtide.schemas import TRADE_SCHEMAS
    from cashtide.sources.model import Model
    from cashtide.sources.tables import read_tables

    m = Model(read_tables(spark, "/root/testdata/sf0.001", TRADE_SCHEMAS, TRADE_SCHEMAS), queries.AS_OF, queries.QUARTER_END)
    both = [m.prior_run, m.as_of]
    once = m.with_stock(both)
    for weeks in ([m.prior_run], [m.as_of], both):
        kept, worked_out = once.inventory(weeks), m.inventory(weeks)
        assert kept.columns == worked_out.columns and kept.count() == worked_out.count() > 0
        assert kept.exceptAll(worked_out).count() == 0
        assert "lineitem" not in kept._jdf.queryExecution().executedPlan().toString()
    # A week that was not asked for is worked out as ever.
    assert once.inventory().count() == m.inventory().count()
