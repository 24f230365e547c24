import datetime as dt
from decimal import Decimal

import golden
import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from cashtide.operators.projection import forecast_rows
from cashtide.plans.catalog import metric_views, register, worksheet
from cashtide.plans.metrics import Composed, Field, Measure, MetricView, flattened, metric_query

# What the five views offer.
FIELDS = {
    "mv_cash_forecast": "forecast_run_date forecast_week_ending driver",
    "mv_ar": "channel status dispute_reason flipped_last_2wk customer_name segment customer_region invoice_date "
    "due_date expected_cash_date",
    "mv_ap": "payment_category supplier_name supplier_category supplier_country scheduled_pay_date actual_pay_date",
    "mv_inventory": "department category subcategory season region location_type store_name week_ending_date "
    "aging_bucket is_aged",
    "mv_sales": "department category season region location_type store_name date_key",
}
MEASURES = {
    "mv_cash_forecast": "projected_cash planned_cash cash_variance projected_quarter_end_cash "
    "planned_quarter_end_cash cash_vs_plan_variance",
    "mv_ar": "total_ar collections_at_risk disputed_ar overdue_ar invoice_count",
    "mv_ap": "total_ap_paid ap_paid_vs_plan early_pay_discount_lost surcharge_paid expedite_freight_paid avg_days_early",
    "mv_inventory": "on_hand_cost aged_inventory_cost markdown_liability on_hand_units inventory_aged_pct",
    "mv_sales": "net_sales gross_sales units_sold cogs discount",
}


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "dim_product": golden.products(spark),
        "dim_store": golden.stores(spark),
        "dim_customer": golden.customers(spark),
        "dim_supplier": golden.suppliers(spark),
        "fact_sales": golden.sales(spark),
        "fact_inventory_snapshot": golden.inventory(spark),
        "fact_purchase_orders": golden.purchase_orders(spark),
        "fact_ap_payments": golden.payables(spark),
        "fact_ar_invoices": golden.receivables(spark),
        "fact_cash_forecast": forecast_rows(golden.amounts(spark), golden.QUARTER_END, golden.HORIZON),
    }


@pytest.fixture(scope="module")
def views(tables):
    return metric_views(tables, golden.AS_OF, golden.QUARTER_END)


def test_all_fields_and_measures_exist(views):
    assert {n: " ".join(f.name for f in v.fields) for n, v in views.items()} == FIELDS
    assert {n: " ".join(m.name for m in v.measures) for n, v in views.items()} == MEASURES
    assert sum(len(v.fields) for v in views.values()) == 36
    assert sum(len(v.measures) for v in views.values()) == 27


@pytest.mark.parametrize("name", list(FIELDS))
def test_every_field_can_be_grouped_and_every_measure_taken(views, name):
    view = views[name]
    fields, measures = FIELDS[name].split(), MEASURES[name].split()
    got = metric_query(view, fields, measures)
    assert got.columns == fields + measures
    assert got.count() > 0
    for field in fields:
        assert metric_query(view, [field], measures[:1]).count() > 0


def test_quarter_end_measures(views):
    got = metric_query(views["mv_cash_forecast"], ["driver"], ["cash_vs_plan_variance"], {"forecast_run_date": golden.AS_OF})
    assert {d: int(v) for d, v in rows(got)} == {
        "BASELINE": 0, "INVENTORY_TRAP": -3_500_000, "COLLECTIONS_SLOWDOWN": -2_500_000, "AP_ACCELERATION": -2_000_000,
    }
    total = metric_query(views["mv_cash_forecast"], [], ["projected_quarter_end_cash", "planned_quarter_end_cash"], {"forecast_run_date": golden.AS_OF})
    assert rows(total) == [(Decimal(22_000_000), Decimal(30_000_000))]


def test_receivables(views):
    got = metric_query(views["mv_ar"], ["customer_name"], MEASURES["mv_ar"].split())
    found = {r[0]: tuple(r)[1:] for r in rows(got)}
    # Due on the as-of day is not overdue; paid invoices never are.
    assert found["Bolt"] == (Decimal(201_999), Decimal(200_000), Decimal(200_000), Decimal(400), 4)
    assert found["Acme"] == (Decimal(1_500_000), Decimal(1_500_000), Decimal(1_500_000), Decimal(1_500_000), 2)
    # A filter that meets nothing gives NULL, not 0.
    assert found["Mart"][2] is None


def test_averages_and_filters(views):
    got = metric_query(views["mv_ap"], [], ["avg_days_early", "total_ap_paid"], {"payment_category": ["ACCELERATED", "NORMAL"]})
    assert got.first().avg_days_early == pytest.approx(90 / 5)
    late = metric_query(views["mv_ap"], ["supplier_country"], ["total_ap_paid"], {"supplier_country": lambda c: c.startswith("P")})
    assert rows(late) == [("Peru", Decimal(1_000_700))]
    none = metric_query(views["mv_ar"], [], ["invoice_count"], {"dispute_reason": None})
    assert none.first().invoice_count == 4


@pytest.mark.parametrize("broadcast", [True, False])
def test_levels_are_not_added_up_over_weeks(views, request, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    view = views["mv_inventory"]
    got = metric_query(view, ["category"], ["on_hand_units", "inventory_aged_pct"])
    assert {r.category: r.on_hand_units for r in got.collect()} == {"Outerwear": 45, "Tops": 60, "Boots": 7}
    assert {r.category: r.inventory_aged_pct for r in got.collect()} == {"Outerwear": 1.0, "Tops": None, "Boots": None}
    weekly = metric_query(view, ["week_ending_date"], ["on_hand_units"])
    assert sorted(r.on_hand_units for r in weekly.collect()) == [99, 112]
    earlier = metric_query(view, [], ["on_hand_units"], {"week_ending_date": golden.d("2026-10-24")})
    assert rows(earlier) == [(99,)]


def test_a_ratio_of_nothing_is_null(views):
    got = metric_query(views["mv_inventory"], [], ["inventory_aged_pct"], {"category": "nonesuch"})
    assert rows(got) == [(None,)]
    assert rows(metric_query(views["mv_ar"], [], ["invoice_count"], {"status": "nonesuch"})) == [(0,)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unused_lookups_are_not_joined(views):
    assert "Join" not in plan(metric_query(views["mv_ar"], ["channel"], ["collections_at_risk"]))
    assert plan(metric_query(views["mv_sales"], ["region"], ["net_sales"])).count("Join") == 1


def test_names(spark, views):
    view = views["mv_cash_forecast"]
    assert view.find("root cause") == "driver"
    assert view.find("gap to plan") == view.find("Quarter-End Cash vs Plan") == "cash_vs_plan_variance"
    with pytest.raises(KeyError):
        view.find("nonesuch")
    with pytest.raises(KeyError):
        metric_query(view, ["projected_cash"], ["driver"])
    described = {r.name: r for r in view.describe(spark).collect()}
    assert described["cash_variance"].synonyms == ["variance", "shortfall"]
    assert described["cash_variance"].format == "currency USD, 0 decimals"
    field = metric_query(view, ["driver"], ["cash_variance"]).schema["cash_variance"]
    assert field.metadata["display_name"] == "Cash Variance vs Plan"


def test_definitions_are_checked(spark):
    df = spark.sql("SELECT 1 AS a")
    with pytest.raises(ValueError, match="used twice"):
        MetricView("v", df, (Field("a", "fact.a"),), (Measure("a", "sum", "a"),))
    loop = MetricView("v", df, (), (Composed("x", "y", ("y",)), Composed("y", "x", ("x",))))
    with pytest.raises(ValueError, match="defined by itself"):
        metric_query(loop, [], ["x"])


def test_measures_build_on_measures(spark):
    df = spark.sql("SELECT * FROM VALUES ('p', 6.00BD, 2), ('q', 1.00BD, 0) AS t(g, amount, units)")
    view = MetricView(
        "v", df, (Field("g", "fact.g"),),
        (
            Measure("amount", "sum", "amount"),
            Measure("units", "sum", "units", type="bigint"),
            Composed("price", "CAST(amount AS DOUBLE) / nullif(units, 0)", ("amount", "units")),
            Composed("double_price", "price * 2", ("price",)),
        ),
    )
    assert sorted(rows(metric_query(view, ["g"], ["double_price"]))) == [("p", 6.0), ("q", None)]


@pytest.fixture
def clean_names(spark):
    yield
    for view in spark.catalog.listTables():
        if view.isTemporary:
            spark.catalog.dropTempView(view.name)


def test_sql_over_registered_names(spark, tables, views, clean_names):
    found = register({**tables, "dim_date": spark.sql("SELECT 1 AS date_key"), "fact_cash_ledger": spark.sql("SELECT 1 AS ledger_date")}, golden.AS_OF, golden.QUARTER_END, golden.LATEST)
    assert set(found) == set(FIELDS)
    assert spark.sql("SELECT deterioration_2wk FROM v_cash_forecast_deterioration").first()[0] == Decimal(-3_000_000)
    assert spark.sql("SELECT ccc_days FROM v_working_capital_cycle").first()[0] is not None
    assert spark.sql("SELECT category FROM v_inventory_sell_through ORDER BY sell_through_rate").first()[0] == "Boots"
    flattened(views["mv_sales"]).createOrReplaceTempView("sales_rows")
    assert spark.sql("SELECT sum(net_sales_amt) FROM sales_rows WHERE region = 'National'").first()[0] == Decimal(20_800)


def test_worksheet_by_name(spark, tables):
    ledger = spark.sql("SELECT DATE'2026-11-05' AS ledger_date")
    questions = worksheet({**tables, "fact_cash_ledger": ledger}, golden.AS_OF, golden.QUARTER_END, golden.LATEST)
    assert len(questions) == 16
    answers = {name: rows(ask()) for name, ask in questions.items()}
    assert all(answers.values())
    assert dict(answers["row_counts"])["fact_sales"] == 6
    for view, base in (("view_cash", "driver_variance"), ("view_ar", "collections_by_channel"), ("view_ap", "ap_components")):
        column = {"view_cash": 1, "view_ar": 1, "view_ap": 2}[view]
        assert dict((r[0], r[1]) for r in answers[view]) == dict((r[0], r[column]) for r in answers[base])
    assert answers["view_inventory"] == [r[:3] for r in answers["aged_inventory"]]


def test_a_level_is_that_of_one_snapshot_under_any_filter(spark):
    data = [("2026-10-17", "a", 1), ("2026-10-24", "a", 10), ("2026-10-24", "b", 20), ("2026-10-31", "a", 100)]
    held = spark.createDataFrame([(day(d), k, v) for d, k, v in data], "week date, kind string, units int")
    view = MetricView(
        "held", held, (Field("week", "fact.week"), Field("kind", "fact.kind")), (Measure("units", "sum", "units", type="bigint"),),
        latest_by="week",
    )

    def units(where=None, dims=()):
        return sorted(tuple(r) for r in metric_query(view, list(dims), ["units"], where).collect())

    assert units() == [(100,)]
    assert units({"week": [day("2026-10-17"), day("2026-10-24")]}) == [(30,)]
    assert units({"week": lambda c: c < F.lit(day("2026-10-31"))}) == [(30,)]
    assert units({"week": day("2026-10-17")}) == [(1,)]
    assert units({"kind": "a", "week": lambda c: c >= F.lit(day("2026-10-17"))}) == [(100,)]
    assert units(None, ["week"]) == [(day("2026-10-17"), 1), (day("2026-10-24"), 30), (day("2026-10-31"), 100)]


SALES = [("N", "a", 1, 10), ("N", "b", 2, 20), ("S", "a", 3, 30), (None, "a", 4, None)]


def sales_by_area(spark):
    fact = spark.createDataFrame(SALES, "area string, kind string, n int, v int")
    return MetricView(
        "m", fact,
        fields=(Field("area", "fact.area"), Field("kind", "fact.kind")),
        measures=(Measure("total", "sum", "v", type="bigint"), Measure("mean", "avg", "v"), Measure("rows", "count"), Composed("per_row", "total / rows", ("total", "rows"))),
    )


def test_each_set_is_a_query_of_its_own(spark):
    view, names = sales_by_area(spark), ["total", "mean", "rows", "per_row"]
    sets = [["area", "kind"], ["kind"], ["area"], []]
    got = metric_query(view, ["area", "kind"], names, sets=sets).collect()
    for number, group in enumerate(sets):
        alone = metric_query(view, group, names).collect()
        mine = [r for r in got if r["grouping_id"] == {0: 0, 1: 2, 2: 1, 3: 3}[number]]
        assert sorted((tuple(r[c] for c in [*group, *names]) for r in mine), key=str) == sorted(map(tuple, alone), key=str)
    # An unknown area is told from all areas.
    assert {r["grouping_id"] for r in got if r["area"] is None and r["kind"] == "a"} == {0, 2}


def test_sets_read_the_fact_once(spark):
    plan = metric_query(sales_by_area(spark), ["area", "kind"], ["total"], sets=[["area"], ["kind"], []])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


@pytest.mark.parametrize("sets", [[], [["area"], ["area"]], [["city"]]])
def test_sets_are_checked(spark, sets):
    with pytest.raises(ValueError, match="sets of fields"):
        metric_query(sales_by_area(spark), ["area", "kind"], ["total"], sets=sets)


@pytest.mark.parametrize("latest", [None, dt.date(2026, 1, 10)])
def test_a_level_in_a_set_without_its_week_is_that_of_the_newest(spark, latest):
    weeks = [dt.date(2026, 1, 3), dt.date(2026, 1, 10)]
    rows = [(weeks[0], "x", 5), (weeks[0], "gone", 9), (weeks[1], "x", 7)]
    fact = spark.createDataFrame(rows, "week date, place string, units int")
    view = MetricView("s", fact, fields=(Field("week", "fact.week"), Field("place", "fact.place")),
                      measures=(Measure("units", "sum", "units", type="bigint"),), latest_by="week", latest=latest)
    got = {(r.week, r.place, r.grouping_id): r.units for r in metric_query(view, ["week", "place"], ["units"], sets=[["week"], ["place"], []]).collect()}
    assert got == {(weeks[0], None, 1): 14, (weeks[1], None, 1): 7, (None, "x", 2): 7, (None, None, 3): 7}
    older = metric_query(view, ["week", "place"], ["units"], {"week": weeks[0]}, sets=[["place"], []])
    assert {(r.place, r.units) for r in older.collect()} == {("x", 5), ("gone", 9), (None, 14)}


def test_only_the_snapshots_asked_for_are_built(spark):
    weeks = tuple(dt.date(2026, 1, 3) + dt.timedelta(weeks=n) for n in range(4))
    asked = []

    def build(some):
        asked.append(list(some))
        return spark.createDataFrame([(w, n) for n, w in enumerate(some)], "week date, units int")

    view = MetricView("s", build(weeks), fields=(Field("week", "fact.week"),), measures=(Measure("units", "sum", "units", type="bigint"),),
                      latest_by="week", latest=weeks[-1], builder=build, weeks=weeks)
    assert metric_query(view, [], ["units"]).collect()[0][0] == 0
    assert metric_query(view, [], ["units"], {"week": list(weeks[:2])}).count() == 1
    assert metric_query(view, ["week"], ["units"], {"week": weeks[1]}).count() == 1
    assert metric_query(view, ["week"], ["units"]).count() == 4
    assert metric_query(view, ["week"], ["units"], {"week": dt.date(2020, 1, 4)}).count() == 0
    assert asked[1:] == [[weeks[3]], [weeks[1]], [weeks[1]], list(weeks)]
