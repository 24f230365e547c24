"""Every registered query against DuckDB on the smallest tables, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry
from cashtide.queries import QUERIES
from verification.compare import compare, connect
from verification.oracle import ORACLE_SQL as SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_each_query_has_its_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = plan_of(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan, node
    # Scans read the columns in use and no others.
    for columns in re.findall(r"lineitem.parquet.*?ReadSchema: struct<(.*?)>", plan):
        assert len(columns.split(",")) <= 8
    same, note, *_ = compare(df, duck, SQL[name])
    assert same, note


def test_limits_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        assert "GreaterThanOrEqual(o_orderdate" in plan_of(QUERIES["q_units_8wk"](spark, FOLDER))
        plan = plan_of(QUERIES["q_aged_inventory"](spark, FOLDER))
        assert "LessThan(l_shipdate" in plan and "EqualTo(l_returnflag,N)" in plan
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", list(QUERIES))
def test_all_sides_too_big_to_broadcast(spark, duck, no_broadcast, name):
    same, note, *_ = compare(QUERIES[name](spark, FOLDER), duck, SQL[name])
    assert same, note


@pytest.mark.parametrize("name", ["q_collections_by_channel", "q_mv_ar", "q_mv_ar_channel", "q_ar_aging"])
def test_invoices_are_summed_before_their_customer_is_looked_up(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    join = plan[plan.index("SortMergeJoin") :]
    orders = join[: join.index("orders.parquet")]
    assert "HashAggregate" in orders.rsplit("Exchange", 2)[1] or orders.count("HashAggregate") >= 2


def test_entry(spark):
    assert entry.entry(spark).columns == ["dso_days", "dpo_days", "dio_days", "ccc_days"]
