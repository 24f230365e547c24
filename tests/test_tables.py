import datetime as dt
import os

import golden
import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from cashtide.schemas import SCHEMAS, TABLE_COMMENTS, TRADE_SCHEMAS, conform
from cashtide.session import shared_dir, stage
from cashtide.sources.tables import (
    comment_table,
    create_schema,
    create_view,
    date_ranges,
    read_catalog,
    read_tables,
    save_model,
    saved_copy,
    table_counts,
    write_table,
)


@pytest.fixture(scope="module")
def schema(spark):
    create_schema(spark, "finance", "Tables for 'cash' questions")
    assert spark.catalog.currentDatabase() == "finance"
    yield "finance"
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP SCHEMA finance CASCADE")


def test_twelve_tables_are_declared():
    assert len(SCHEMAS) == len(TABLE_COMMENTS) == 12
    assert SCHEMAS["fact_sales"]["net_sales_amt"].dataType.simpleString() == "decimal(12,2)"
    assert SCHEMAS["fact_cash_ledger"]["running_cash_balance"].dataType.simpleString() == "decimal(28,2)"
    assert all(f.metadata["comment"] for s in SCHEMAS.values() for f in s.fields)
    assert sum(len(s.fields) for s in SCHEMAS.values()) == 117


def test_trade_schemas_are_those_of_the_files(spark):
    for name, declared in TRADE_SCHEMAS.items():
        assert spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").schema == declared, name


def test_conform_casts_orders_and_completes(spark):
    df = spark.sql("SELECT 7L AS store_id, 'x' AS store_name, 1 AS extra")
    got = conform(df, SCHEMAS["dim_store"])
    assert got.schema == SCHEMAS["dim_store"] or [f.dataType for f in got.schema] == [f.dataType for f in SCHEMAS["dim_store"]]
    assert got.first().asDict() == {
        "store_id": "7", "store_name": "x", "location_type": None, "region": None, "state": None, "city": None, "open_date": None,
    }


def test_save_and_read_back(spark, schema):
    save_model({"fact_sales": golden.sales(spark), "dim_store": golden.stores(spark)})
    tables = read_catalog(spark, ["fact_sales", "dim_store"])
    assert tables["fact_sales"].count() == 6
    comments = {c.name: c.description for c in spark.catalog.listColumns("fact_sales")}
    assert comments["cogs_amt"] == "units at cost"
    assert any(c.isPartition and c.name == "date_key" for c in spark.catalog.listColumns("fact_sales"))
    assert spark.catalog.getTable("dim_store").description == TABLE_COMMENTS["dim_store"]
    # A filter on the day reads only that day's folder.
    plan = tables["fact_sales"].filter(F.col("date_key") == F.lit(day("2026-10-31")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_key" in plan


def test_overwrite_replaces_rows_and_columns(spark, schema):
    write_table(spark.sql("SELECT 1 AS a"), "scratch_rows")
    write_table(spark.sql("SELECT 'x' AS b, 2 AS c"), "scratch_rows")
    assert spark.table("scratch_rows").columns == ["b", "c"]
    assert rows(spark.table("scratch_rows")) == [("x", 2)]
    comment_table(spark, "scratch_rows", "It's new", {"b": "a 'text'"})
    assert spark.catalog.getTable("scratch_rows").description == "It's new"
    assert {c.name: c.description for c in spark.catalog.listColumns("scratch_rows")}["b"] == "a 'text'"


def test_tables_bucketed_alike_join_without_a_shuffle(spark, schema, no_broadcast):
    write_table(spark.range(500).selectExpr("id % 100 AS k", "id AS v"), "left_rows", bucket_by=(4, "k"))
    write_table(spark.range(100).selectExpr("id AS k", "id * 2 AS w"), "right_rows", bucket_by=(4, "k"))
    joined = spark.table("left_rows").join(spark.table("right_rows"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 500


def test_a_hot_day_is_written_by_several_tasks(spark, schema):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "30KB")
    try:
        df = spark.range(0, 60_000, 1, 6).selectExpr("uuid() AS u", "if(id % 3 = 0, DATE'2026-01-01', date_add(DATE'2026-01-02', CAST(id % 5 AS INT))) AS d")
        write_table(df, "hot_days", "d")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in spark.table("hot_days").inputFiles() if "d=2026-01-01" in f]
    assert len(files) > 1
    assert spark.table("hot_days").count() == 60_000


def test_stored_view(spark, schema):
    write_table(spark.range(5).toDF("n"), "numbers")
    create_view(spark, "big_numbers", "SELECT n FROM numbers WHERE n > 2", "above two")
    create_view(spark, "big_numbers", "SELECT n FROM numbers WHERE n > 3", "above three")
    assert rows(spark.sql("SELECT * FROM big_numbers")) == [(4,)]
    assert spark.catalog.getTable("big_numbers").description == "above three"


def test_counts_and_ranges(spark):
    counts = table_counts({"b": spark.range(3), "a": spark.range(0)})
    assert rows(counts) == [("a", 0), ("b", 3)]
    ranges = date_ranges({"fact_sales": (golden.sales(spark), "date_key")})
    assert rows(ranges) == [("fact_sales", day("2026-08-07"), day("2026-10-31"))]


def test_tables_open_on_demand(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    tables = read_tables(spark, str(tmp_path), ["t", "absent"])
    assert list(tables) == ["t", "absent"] and len(tables) == 2
    assert tables["t"].count() == 3
    with pytest.raises(KeyError):
        tables["other"]


def test_staged_copies_go_to_the_shared_folder(spark):
    folder = shared_dir(spark)
    assert folder.rstrip("/").endswith(spark.conf.get("spark.checkpoint.dir").rstrip("/").split("/")[-1]) or "shared" in folder
    copy = stage(spark.range(4).withColumn("x", F.rand()), "sample")
    assert rows(copy.orderBy("id")) == rows(copy.orderBy("id"))
    assert all("shared" in f for f in copy.inputFiles())
    assert os.path.isdir(folder.removeprefix("file:"))


def test_without_a_named_folder_the_warehouse_is_shared():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "file:/shared/warehouse" if key == "spark.sql.warehouse.dir" else default

    assert shared_dir(Session) == "file:/shared/warehouse/staged"


def test_balances_of_any_size_conform(spark):
    big = spark.sql("SELECT DATE'2026-11-05' AS ledger_date, 'X' AS cash_category, CAST(1e15 AS DECIMAL(28,2)) AS running_cash_balance")
    assert conform(big, SCHEMAS["fact_cash_ledger"]).first().running_cash_balance == 10**15



def test_a_saved_copy_is_read_by_the_days_asked_for(spark):
    days = [dt.date(2026, 1, 3), dt.date(2026, 1, 10)]
    columns = SCHEMAS["fact_sales"].fields
    rows = spark.createDataFrame([(d, n) for n, d in enumerate(days * 2)], "date_key date, n int")
    full = rows.select(*(F.col("date_key") if f.name == "date_key" else F.col("n").cast("string").cast(f.dataType).alias(f.name) for f in columns))
    schema, saved = saved_copy({"fact_sales": full})
    try:
        newest = saved["fact_sales"].filter(F.col("date_key") == F.lit(days[1]))
        plan = newest._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(date_key" in plan
        assert newest.count() == 2 and len(newest.inputFiles()) < len(saved["fact_sales"].inputFiles())
        assert saved["fact_sales"].schema.fieldNames()[-1] == "date_key"
        other, _ = saved_copy({"fact_sales": full})
        assert other != schema
        spark.sql(f"DROP SCHEMA {other} CASCADE")
    finally:
        spark.sql(f"DROP SCHEMA {schema} CASCADE")
