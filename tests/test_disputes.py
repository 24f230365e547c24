"""Disputes are those of all customers, with an account or without."""

import datetime as dt
from decimal import Decimal

from cashtide.plans import worksheet
from cashtide.schemas import TRADE_SCHEMAS
from cashtide.sources.model import Model

AS_OF = dt.date(2001, 6, 30)


def test_orders_paid_at_once_are_disputed_too(spark):
    source = {name: spark.createDataFrame([], schema) for name, schema in TRADE_SCHEMAS.items()}
    named = [(key, f"customer {key}", None, None, None) for key in (4, 5, 6)]
    source["customer"] = spark.createDataFrame(named, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double")
    days = [dt.datetime(2001, 6, 20), dt.datetime(2001, 1, 5), dt.datetime(2001, 7, 1)]
    # The remainder of the order's key by three is not 0, so all of status P are disputed; the last was not yet placed.
    orders = [(1, 4, "P", 10.0, days[0]), (2, 5, "P", 20.0, days[1]), (4, 5, "P", 30.0, days[0]), (5, 6, "P", 40.0, days[1]), (7, 6, "F", 50.0, days[1]), (8, 5, "P", 60.0, days[2]), (10, None, "P", 70.0, days[1])]
    source["orders"] = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp")
    m = Model(source, AS_OF, dt.date(2001, 9, 30))
    found = {tuple(r) for r in worksheet.disputes(m.receivables(False, paid_at_once=True), m.customers()).collect()}
    assert found == {
        ("customer 4", "quality defect", Decimal("10.00"), True),
        ("customer 5", "pricing discrepancy", Decimal("50.00"), True),
        ("customer 6", "short-ship", Decimal("40.00"), False),
    }
    assert {r.invoice_id for r in m.receivables(False).collect()} == {1}


def test_q_disputes_has_every_disputed_order(spark):
    from cashtide.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet").filter("o_orderstatus = 'P' AND o_orderkey % 3 <> 0 AND o_orderdate < '2001-07-01'")
    whole = orders.selectExpr("sum(CAST(o_totalprice AS DECIMAL(12,2))) AS v").first().v
    assert QUERIES["q_disputes"](spark, folder).selectExpr("sum(disputed_amount) AS v").first().v == whole
