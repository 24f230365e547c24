"""Every operator and report, run over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.functions.amounts import TOTAL, padded_id, swap_prefix, total
from cashtide.functions.dates import fiscal_quarter, trailing, week_ending
from cashtide.operators.allocate import allocate_exact, even_split
from cashtide.operators.ordered import daily_change, daily_fill, fill_nulls, ordinal_fraction, position, running_total, trailing_share
from cashtide.operators.star import Lookup, aggregate_by_attributes, side_by_side, sums, unique_by
from cashtide.plans import actions, evidence, kpis, reports, worksheet
from cashtide.plans.alerts import cash_alert, drift_alert
from cashtide.plans.briefing import briefing
from cashtide.plans.forecast import backtested_forecast, balance_series, predict_cash_flow, rolling_weeks
from cashtide.plans.metric_views import ap_view, ar_view, cash_forecast_view, inventory_view, sales_view
from cashtide.plans.metrics import MetricView, metric_query
from cashtide.plans.path import historic_path, quarter_profile
from cashtide.plans.reconcile import quarter_end_totals, reconcile, same_result
from cashtide.schemas import TRADE_SCHEMAS
from cashtide.session import stage
from cashtide.sources.model import Model
from cashtide.sources.tables import date_ranges, read_tables, saved_copy, stacked, table_counts

AS_OF = dt.date(2001, 6, 30)
QUARTER_END = dt.date(2001, 9, 30)
PLAN_RATE = 0.70
WEAK_RATE = 0.50
TARGET_WEEKS = 6
CONFIDENT = 0.25

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    """Register a builder under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Model(read_tables(spark, sf_dir, TRADE_SCHEMAS, TRADE_SCHEMAS), AS_OF, QUARTER_END))

    QUERIES[build.__name__] = run
    return build


# shared pieces ------------------------------------------------------------------------------------


def _recent_sales(m: Model, *columns: str) -> DataFrame:
    return m.sales("date_key", *columns)


def _recent_payments(m: Model) -> DataFrame:
    return m.payables(m.as_of - dt.timedelta(days=90), m.as_of)


def _owed_view(m: Model) -> MetricView:
    return ar_view(m.receivables(False), m.customers(), m.as_of, channel="customer.channel")


def _stock(m: Model) -> DataFrame:
    """The newest snapshot only; its date is known, so no other week is computed."""
    return m.inventory([m.as_of])


def _stock_view(m: Model) -> MetricView:
    """Twelve weeks of snapshots, of which a query works out those it asks for."""
    return inventory_view(m.inventory(), m.products(), m.stores(), m.as_of, m.inventory, m.snapshot_weeks())


def _rates(m: Model) -> DataFrame:
    return kpis.sell_through(_recent_sales(m, "product_id", "units_sold"), _stock(m), m.products(), m.as_of)


def _cycle(m: Model) -> DataFrame:
    return kpis.working_capital_cycle(
        _recent_sales(m, "net_sales_amt", "cogs_amt"), _stock(m), m.receivables(False), _recent_payments(m), m.as_of,
        latest=m.as_of,
    )


def _moves(m: Model) -> DataFrame:
    sales = _recent_sales(m, "product_id", "store_id", "units_sold")
    return actions.reflow(actions.stock_balance(_stock(m), sales, m.as_of, 8, TARGET_WEEKS))


def _runs(m: Model, count: int) -> list[dt.date]:
    return [m.as_of - dt.timedelta(days=14 * n) for n in reversed(range(count))]


# tables and dates ---------------------------------------------------------------------------------


@query
def q_table_counts(m: Model) -> DataFrame:
    return table_counts(m.counted())


@query
def q_fact_date_ranges(m: Model) -> DataFrame:
    return date_ranges(
        {
            "fact_sales": (m.sales("date_key"), "date_key"),
            "fact_cash_ledger": (m.ledger(), "ledger_date"),
            "fact_cash_forecast": (m.forecast(), "forecast_week_ending"),
        }
    )


@query
def q_calendar(m: Model) -> DataFrame:
    return m.dates()


@query
def q_sales_valued(m: Model) -> DataFrame:
    """Valued sales lines, added up by day and store."""
    lines = m.sales("date_key", "store_id", "units_sold", "gross_sales_amt", "discount_amt", "net_sales_amt", "cogs_amt")
    return lines.groupBy("date_key", "store_id").agg(
        F.sum("units_sold").cast("bigint").alias("units_sold"),
        *(total(c).alias(c) for c in ("gross_sales_amt", "discount_amt", "net_sales_amt", "cogs_amt")),
    )


@query
def q_id_format(m: Model) -> DataFrame:
    sku = padded_id("SKU", "p_partkey", 8)
    return m.source["part"].select(
        F.col("p_partkey").alias("product_id"), sku.alias("sku"), swap_prefix(sku, "SKU", "INV").alias("snapshot_code")
    )


# worksheet ----------------------------------------------------------------------------------------


@query
def q_plan_vs_projected(m: Model) -> DataFrame:
    return worksheet.plan_vs_projected(m.forecast(), m.quarter_end)


@query
def q_deterioration(m: Model) -> DataFrame:
    return kpis.deterioration(m.forecast(), m.quarter_end)


@query
def q_driver_variance(m: Model) -> DataFrame:
    return worksheet.driver_variance(m.forecast([m.as_of]), m.as_of, m.quarter_end)


@query
def q_sell_through(m: Model) -> DataFrame:
    return _rates(m).orderBy("sell_through_rate")


@query
def q_aged_inventory(m: Model) -> DataFrame:
    return worksheet.aged_inventory(_stock(m), m.products(), m.as_of)


@query
def q_po_by_status(m: Model) -> DataFrame:
    return worksheet.po_by_status(m.purchase_orders(with_order_date=False))


@query
def q_collections_by_channel(m: Model) -> DataFrame:
    return worksheet.collections_by_channel(m.receivables(False), m.customers())


@query
def q_disputes(m: Model) -> DataFrame:
    """Disputes of all customers: an order that was paid at once can be disputed like an invoice."""
    return worksheet.disputes(m.receivables(False, paid_at_once=True), m.customers())


@query
def q_ap_components(m: Model) -> DataFrame:
    return worksheet.ap_components(m.payables())


@query
def q_working_capital(m: Model) -> DataFrame:
    return _cycle(m)


# metric views -------------------------------------------------------------------------------------


@query
def q_mv_cash(m: Model) -> DataFrame:
    view = cash_forecast_view(m.forecast(), m.quarter_end)
    return metric_query(view, ["forecast_run_date", "driver"], [x.name for x in view.measures])


@query
def q_mv_cash_current(m: Model) -> DataFrame:
    view = cash_forecast_view(m.forecast(), m.quarter_end)
    found = metric_query(view, ["driver"], ["cash_vs_plan_variance"], {"forecast_run_date": m.as_of})
    return found.withColumnRenamed("cash_vs_plan_variance", "quarter_end_variance").orderBy("quarter_end_variance")


@query
def q_mv_inventory(m: Model) -> DataFrame:
    """Twelve weeks of snapshots; without a week in the query only the newest counts."""
    view = _stock_view(m)
    found = metric_query(view, ["department", "category", "region"], [x.name for x in view.measures])
    return found.withColumn("inventory_aged_pct", F.round("inventory_aged_pct", 4))


@query
def q_mv_inventory_weeks(m: Model) -> DataFrame:
    """Grouped by week, every snapshot counts once."""
    view = _stock_view(m)
    return metric_query(view, ["week_ending_date", "aging_bucket"], ["on_hand_units", "on_hand_cost"])


@query
def q_mv_inventory_two_weeks(m: Model) -> DataFrame:
    """A filter that two weeks meet: a level is still that of one week, the newest of them."""
    view = _stock_view(m)
    weeks = [m.as_of - dt.timedelta(weeks=2), m.as_of - dt.timedelta(weeks=1)]
    return metric_query(view, ["region"], ["on_hand_units", "on_hand_cost"], {"week_ending_date": weeks})


@query
def q_mv_inventory_goods(m: Model) -> DataFrame:
    view = inventory_view(m.inventory([m.as_of]), m.products(), m.stores(), m.as_of)
    return metric_query(view, ["subcategory", "season", "location_type", "store_name"], ["on_hand_units", "on_hand_cost"])


@query
def q_mv_sales_goods(m: Model) -> DataFrame:
    view = sales_view(m.sales("date_key", "product_id", "store_id", "net_sales_amt", "units_sold"), m.products(), m.stores())
    return metric_query(view, ["category", "season"], ["net_sales", "units_sold"])


@query
def q_mv_cash_weeks(m: Model) -> DataFrame:
    view = cash_forecast_view(m.forecast(), m.quarter_end)
    return metric_query(view, ["forecast_week_ending"], ["projected_cash", "cash_variance"], {"forecast_run_date": m.as_of})


@query
def q_mv_ar_status(m: Model) -> DataFrame:
    dims = ["status", "dispute_reason", "flipped_last_2wk", "segment"]
    return metric_query(_owed_view(m), dims, ["total_ar", "disputed_ar", "invoice_count"])


@query
def q_mv_ar_customers(m: Model) -> DataFrame:
    """Open invoices by customer: filters on three dates before the sums."""
    where = {
        "due_date": lambda c: c <= F.lit(m.as_of),
        "invoice_date": lambda c: trailing(c, m.as_of, 365),
        "expected_cash_date": lambda c: c <= F.lit(m.quarter_end),
        "status": ["OPEN", "SLIPPED"],
    }
    return metric_query(_owed_view(m), ["customer_name"], ["total_ar", "invoice_count"], where)


@query
def q_mv_ar_dates(m: Model) -> DataFrame:
    return metric_query(_owed_view(m), ["invoice_date", "due_date", "expected_cash_date"], ["total_ar"])


@query
def q_mv_ap_suppliers(m: Model) -> DataFrame:
    view = ap_view(m.payables(), m.suppliers())
    return metric_query(view, ["supplier_name", "supplier_category"], ["total_ap_paid", "ap_paid_vs_plan"])


@query
def q_mv_ap_dates(m: Model) -> DataFrame:
    view = ap_view(m.payables(), m.suppliers())
    return metric_query(view, ["scheduled_pay_date", "actual_pay_date"], ["total_ap_paid"])


@query
def q_mv_aged(m: Model) -> DataFrame:
    view = _stock_view(m)
    found = metric_query(
        view, ["department", "category"], ["aged_inventory_cost"], {"week_ending_date": m.as_of, "is_aged": True}
    )
    return found.withColumnRenamed("aged_inventory_cost", "aged_cost").orderBy(F.desc("aged_cost"))


@query
def q_mv_ar(m: Model) -> DataFrame:
    view = _owed_view(m)
    return metric_query(view, ["channel", "customer_region"], [x.name for x in view.measures])


@query
def q_mv_ar_channel(m: Model) -> DataFrame:
    view = _owed_view(m)
    return metric_query(view, ["channel"], ["collections_at_risk"]).orderBy(F.desc("collections_at_risk"))


@query
def q_mv_ap(m: Model) -> DataFrame:
    view = ap_view(m.payables(), m.suppliers())
    found = metric_query(view, ["payment_category", "supplier_country"], [x.name for x in view.measures])
    return found.withColumn("avg_days_early", F.round("avg_days_early", 4))


@query
def q_mv_ap_category(m: Model) -> DataFrame:
    view = ap_view(m.payables(), m.suppliers())
    found = metric_query(view, ["payment_category"], ["ap_paid_vs_plan"])
    return found.withColumnRenamed("ap_paid_vs_plan", "ap_cash_out_vs_plan").orderBy(F.desc("ap_cash_out_vs_plan"))


@query
def q_mv_sales(m: Model) -> DataFrame:
    view = sales_view(m.sales(), m.products(), m.stores())
    return metric_query(view, ["department", "region", "location_type"], [x.name for x in view.measures])


@query
def q_mv_sales_sets(m: Model) -> DataFrame:
    """Sales by department and region, by each alone, and in all, in one pass."""
    view = sales_view(m.sales("date_key", "product_id", "store_id", "net_sales_amt", "units_sold"), m.products(), m.stores())
    sets = [["category", "region"], ["category"], ["region"], []]
    return metric_query(view, ["category", "region"], ["net_sales", "units_sold"], sets=sets)


@query
def q_mv_inventory_sets(m: Model) -> DataFrame:
    """Stock and its aged share by week and region; without the week only the newest one counts."""
    sets = [["week_ending_date", "region"], ["week_ending_date"], ["region"], []]
    found = metric_query(
        _stock_view(m), ["week_ending_date", "region"], ["on_hand_units", "on_hand_cost", "inventory_aged_pct"], sets=sets
    )
    return found.withColumn("inventory_aged_pct", F.round("inventory_aged_pct", 4))


@query
def q_metric_filtered(m: Model) -> DataFrame:
    """Filters on a dimension field and on a fact field, before aggregation."""
    view = sales_view(m.sales("date_key", "product_id", "store_id", "net_sales_amt", "units_sold"), m.products(), m.stores())
    where = {"region": ["ASIA", "EUROPE"], "date_key": lambda c: trailing(c, m.as_of, 90)}
    return metric_query(view, ["store_name"], ["net_sales", "units_sold"], where)


@query
def q_saved_model(m: Model) -> DataFrame:
    """The working-capital cycle over facts that were written by date and read back by name.

    Written are the quarter's sales and payments and twelve weeks of snapshots, which are what the
    cycle reads of them; a folder per day of all years takes minutes on one machine.
    """
    facts = {
        "fact_sales": m.sales().filter(trailing("date_key", m.as_of, 90)),
        "fact_inventory_snapshot": m.inventory(),
        "fact_ap_payments": _recent_payments(m),
    }
    _, saved = saved_copy(facts)
    return kpis.working_capital_cycle(
        saved["fact_sales"], saved["fact_inventory_snapshot"], m.receivables(False), saved["fact_ap_payments"], m.as_of,
        latest=m.as_of,
    )


# preparation --------------------------------------------------------------------------------------


@query
def q_inventory_snapshot(m: Model) -> DataFrame:
    return m.inventory().select(
        "week_ending_date", "product_id", "store_id", F.col("on_hand_units").cast("bigint").alias("on_hand_units"),
        "on_hand_cost", "last_receipt_date", "days_on_hand", "aging_bucket", "is_aged", "markdown_liability_amt",
    )


@query
def q_units_8wk(m: Model) -> DataFrame:
    return kpis.units_by_category(_recent_sales(m, "product_id", "units_sold"), m.products(), m.as_of)


@query
def q_allocate_exact(m: Model) -> DataFrame:
    """Each channel's cash at risk over its customers, in proportion to what they were invoiced."""
    sums_of = m.receivables(False).groupBy("customer_id").agg(
        total("amount").alias("invoiced"), total("cash_impact_vs_plan_amt").alias("risk")
    )
    channels = unique_by(m.customers().select("customer_id", "channel"), "customer_id")
    # One row per customer feeds every step.
    owed = stage(sums_of.join(channels, "customer_id", "left"), "owed")
    risk = owed.groupBy("channel").agg(total("risk").alias("at_risk"))
    return allocate_exact(owed.select("channel", "customer_id", "invoiced"), risk, "at_risk", "invoiced", ["channel"], "customer_id")


@query
def q_even_split(m: Model) -> DataFrame:
    """Each category's open order units evenly over its products."""
    units = aggregate_by_attributes(
        m.purchase_orders(with_order_date=False).filter(F.col("status") == "OPEN"),
        [Lookup("product", m.products(), "product_id", "product_id")],
        [("category", "product.category")],
        sums(open_units="ordered_units"),
    )
    return even_split(m.products().select("category", "product_id"), units, "open_units", ["category"], "product_id")


@query
def q_running_total(m: Model) -> DataFrame:
    """Invoiced so far per channel, at every invoice."""
    owed = m.receivables().select("channel", "invoice_id", "amount")
    return running_total(owed, "amount", ["channel"], "invoice_id", "invoiced_so_far").withColumn(
        "invoiced_so_far", F.col("invoiced_so_far").cast(TOTAL)
    )


@query
def q_running_total_nulls(m: Model) -> DataFrame:
    """Disputed so far per channel, at every invoice: NULL until the first dispute, and most invoices add nothing."""
    owed = m.receivables().selectExpr("channel", "invoice_id", "if(dispute_flag, amount, NULL) AS amount")
    return running_total(owed, "amount", ["channel"], "invoice_id", "disputed_so_far", 7).withColumn(
        "disputed_so_far", F.col("disputed_so_far").cast(TOTAL)
    )


@query
def q_position(m: Model) -> DataFrame:
    """Every invoice's number within its channel."""
    return position(m.receivables().select("channel", "invoice_id"), ["channel"], "invoice_id", "place")


@query
def q_fill_nulls(m: Model) -> DataFrame:
    """The latest dispute reason seen in a channel, at every invoice."""
    owed = m.receivables().select("channel", "invoice_id", "dispute_reason")
    return fill_nulls(owed, "dispute_reason", ["channel"], "invoice_id")


@query
def q_ledger(m: Model) -> DataFrame:
    return m.ledger()


@query
def q_category_shares(m: Model) -> DataFrame:
    """A day's cash in and out by category, with the category's share of its direction over 13 weeks."""
    sides = "inline(array(named_struct('direction', 'IN', 'amount', cash_in_amt), named_struct('direction', 'OUT', 'amount', cash_out_amt)))"
    daily = m.ledger().selectExpr("ledger_date", "cash_category", sides).filter("amount <> 0")
    return trailing_share(daily, "ledger_date", "amount", "cash_category", 91, ["direction"])


@query
def q_balance_fill(m: Model) -> DataFrame:
    """A balance noted on Saturdays only, filled backward and then forward."""
    daily = balance_series(m.ledger(), False)
    noted = daily.select("segment", "day", F.when(week_ending("day") == F.col("day"), F.col("balance")).alias("balance"))
    return daily_fill(noted, "day", "balance", by=["segment"], backward_first=True).drop("segment")


@query
def q_balance_delta(m: Model) -> DataFrame:
    daily = balance_series(m.ledger(), False)
    return daily_change(daily, "day", "balance", by=["segment"]).select(
        "day", "balance", F.col("change").cast(TOTAL).alias("change")
    )


@query
def q_week_fraction(m: Model) -> DataFrame:
    """How far into its quarter each week is, with the week's sales."""
    weekly = (
        m.sales_by_day()
        .groupBy(fiscal_quarter("date_key").alias("fiscal_quarter"), week_ending("date_key").alias("week_ending_date"))
        .agg(total("net_sales_amt").alias("net_sales_amt"))
    )
    return ordinal_fraction(weekly, ["fiscal_quarter"], "week_ending_date").select(
        "fiscal_quarter", "week_ending_date", "net_sales_amt", F.col("ordinal").cast("bigint").alias("ordinal"),
        F.round("fraction", 4).alias("fraction"),
    )


@query
def q_forecast_rows(m: Model) -> DataFrame:
    return m.forecast()


@query
def q_quarter_profile(m: Model) -> DataFrame:
    """By which week of a quarter how much of its change in cash has come, as past quarters went."""
    return quarter_profile(balance_series(m.ledger(), False).select("day", "balance"), m.prior_run)


@query
def q_forecast_path(m: Model) -> DataFrame:
    """Weekly plan and projection of all cash, along the profile of past quarters."""
    daily = balance_series(m.ledger(), False).select("day", "balance")
    return historic_path(m.forecast_amounts(), daily, [m.prior_run, m.as_of], m.quarter_end)


@query
def q_dso_target_ar(m: Model) -> DataFrame:
    return reports.open_ar_target(
        _recent_sales(m, "net_sales_amt"), m.as_of, Decimal("45.00"), Decimal("2500000.00"), Decimal("250000.00")
    ).withColumn("net_sales", F.col("net_sales").cast(TOTAL))


# reports ------------------------------------------------------------------------------------------


@query
def q_ar_aging(m: Model) -> DataFrame:
    return reports.ar_aging(m.receivables(False), m.as_of, m.customers())


@query
def q_ap_schedule(m: Model) -> DataFrame:
    return reports.ap_schedule(m.payables(), m.as_of)


@query
def q_inventory_aging(m: Model) -> DataFrame:
    return reports.inventory_aging(_stock(m), m.products(), m.stores(), m.as_of)


@query
def q_sell_through_gap(m: Model) -> DataFrame:
    return reports.sell_through_gap(_rates(m), PLAN_RATE)


@query
def q_terms_variance(m: Model) -> DataFrame:
    return reports.terms_variance(m.payables(), m.suppliers())


@query
def q_waterfall(m: Model) -> DataFrame:
    return reports.waterfall(m.forecast([m.as_of]), m.as_of, m.quarter_end)


@query
def q_forecast(m: Model) -> DataFrame:
    """Balances of all cash and of each category at the month ends to quarter-end."""
    ledger = stage(m.ledger(), "ledger")
    ends = [dt.date(2001, 7, 31), dt.date(2001, 8, 31), m.quarter_end]
    return stacked([predict_cash_flow(ledger, m.as_of, ends), predict_cash_flow(ledger, m.as_of, ends, by_category=True)])


@query
def q_forecast_seasonal(m: Model) -> DataFrame:
    """The next two weeks day by day, with effects of the day of the week, from the last year."""
    ahead = [m.as_of + dt.timedelta(days=n) for n in range(1, 15)]
    return predict_cash_flow(stage(m.ledger(), "ledger"), m.as_of, ahead, history_days=365, seasonal=True)


@query
def q_forecast_backtest(m: Model) -> DataFrame:
    """The next thirteen weeks, with intervals from how far past forecasts were off."""
    return backtested_forecast(m.ledger(), m.as_of, [7 * n for n in range(1, 14)])


@query
def q_rolling_weeks(m: Model) -> DataFrame:
    return rolling_weeks(stage(m.ledger(), "ledger"), m.as_of)


@query
def q_alert(m: Model) -> DataFrame:
    return cash_alert(m.forecast(_runs(m, 6)), m.quarter_end, 1_000_000, 100_000)


@query
def q_alert_drift(m: Model) -> DataFrame:
    """Runs whose small losses have added up."""
    return drift_alert(m.forecast(_runs(m, 6)), m.quarter_end, 500_000, 1_000_000)


# actions ------------------------------------------------------------------------------------------


@query
def q_cancel_pos(m: Model) -> DataFrame:
    return actions.cancel_orders(m.purchase_orders(with_order_date=False), m.products(), _rates(m), m.as_of, WEAK_RATE)


@query
def q_defer_payments(m: Model) -> DataFrame:
    return actions.defer_payments(m.payables(after=m.as_of), m.suppliers(), m.as_of, m.quarter_end)


@query
def q_chase_collections(m: Model) -> DataFrame:
    return actions.chase_collections(m.receivables(False), m.customers(), m.as_of, CONFIDENT)


@query
def q_reflow(m: Model) -> DataFrame:
    return _moves(m)


# text, checks, briefing ---------------------------------------------------------------------------


@query
def q_evidence(m: Model) -> DataFrame:
    rules = (*evidence.FINANCE_RULES, *evidence.CONTACT_RULES)
    return evidence.extract_evidence(m.source["documents"], rules)


@query
def q_evidence_summary(m: Model) -> DataFrame:
    rules = (*evidence.FINANCE_RULES, *evidence.CONTACT_RULES)
    return evidence.evidence_summary(evidence.extract_evidence(m.source["documents"], rules))


@query
def q_evidence_conversations(m: Model) -> DataFrame:
    """Findings in messages by rule and value."""
    rules, key = (*evidence.FINANCE_RULES, *evidence.CONTACT_RULES), ("conv_id", "turn")
    return evidence.evidence_summary(evidence.extract_evidence(m.source["conversations"], rules, key), key)


def _apart(m: Model) -> DataFrame:
    """What the checks compare with, from the trade tables and the facts at the prior run, not from a forecast."""
    late = f"o_orderstatus = 'P' AND o_orderdate < DATE'{m.as_of + dt.timedelta(days=1)}'"
    late += f" AND o_orderdate >= DATE'{m.quarter_end - dt.timedelta(days=104)}' AND {Model.invoiced('o_custkey')}"
    trade = m.source["orders"].filter(late).agg(
        total("CAST(o_totalprice AS DECIMAL(12,2))", "o_orderkey % 3 <> 0").alias("disputed_apart"),
        total("CAST(o_totalprice AS DECIMAL(12,2))", "o_orderkey % 3 = 0").alias("slipped_apart"),
    )
    trade = trade.selectExpr("coalesce(disputed_apart, 0) AS disputed_apart", "coalesce(slipped_apart, 0) AS slipped_apart")
    run = m.prior_run
    stock = m.inventory([run]).filter("is_aged").agg(total("on_hand_cost").alias("v"))
    owed = m.receivables(False).filter(f"invoice_date <= DATE'{run}'").agg(total("cash_impact_vs_plan_amt").alias("v"))
    paid = m.payables(until=run).agg(total("cash_impact_vs_plan_amt", "payment_category = 'ACCELERATED'").alias("v"))
    gap = stacked([stock, owed, paid]).agg(F.expr("coalesce(sum(v), 0) AS prior_gap"))
    return side_by_side([trade, gap])


def _booked_once(m: Model, ledger: DataFrame) -> DataFrame:
    """Cash in by category as the ledger has it, and order by order: an order is sold for cash or invoiced."""
    booked = ledger.groupBy("cash_category").agg(total("cash_in_amt").alias("v")).filter("v <> 0")
    net = (
        "CAST(l_extendedprice AS DECIMAL(12,2)) "
        "- CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(12,2))"
    )
    lines = m.source["lineitem"].groupBy("l_orderkey").agg(total(net).alias("sold"))
    invoiced = Model.invoiced("o_custkey")
    paid = f"o_orderstatus = 'F' AND o_orderdate < DATE'{m.as_of + dt.timedelta(days=1)}'"
    each = m.source["orders"].join(lines, F.expr("o_orderkey = l_orderkey"), "left").selectExpr(
        f"if({invoiced}, 'WHOLESALE_COLLECTIONS', 'SALES_RECEIPTS') AS cash_category",
        f"CASE WHEN NOT ({invoiced}) THEN sold WHEN {paid} THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS v",
    )
    apart = each.groupBy("cash_category").agg(total("v").alias("v")).filter("v <> 0")
    return same_result("cash_in_booked_once", booked, apart, ["cash_category"], "v")


@query
def q_reconcile(m: Model) -> DataFrame:
    """Facts against the forecast, and each metric view against its base-table query.

    Stock at both runs and the ledger are facts that several checks read: each is worked out once.
    """
    m = m.with_stock([m.prior_run, m.as_of])
    forecast, stock, ledger = stage(m.forecast(), "forecast"), _stock(m), stage(m.ledger(), "ledger")
    owed, paid = m.receivables(False), m.payables()
    done = m.payables(until=m.as_of)
    checks = reconcile(
        stock, owed, done, ledger, forecast, m.as_of, m.prior_run, m.quarter_end, m.as_of, apart=_apart(m)
    )
    cash = cash_forecast_view(forecast, m.quarter_end)
    held = inventory_view(stock, m.products(), m.stores(), m.as_of)
    pairs = [
        same_result(
            "cash_view",
            metric_query(cash, ["driver"], ["cash_vs_plan_variance"], {"forecast_run_date": m.as_of})
            .withColumnRenamed("cash_vs_plan_variance", "variance"),
            worksheet.driver_variance(forecast, m.as_of, m.quarter_end), ["driver"], "variance",
        ),
        same_result(
            "inventory_view",
            metric_query(held, ["department", "category"], ["aged_inventory_cost"], {"is_aged": True})
            .withColumnRenamed("aged_inventory_cost", "aged_on_hand_cost"),
            worksheet.aged_inventory(stock, m.products(), m.as_of), ["department", "category"], "aged_on_hand_cost",
        ),
        same_result(
            "ar_view",
            metric_query(_owed_view(m), ["channel"], ["collections_at_risk"]),
            worksheet.collections_by_channel(owed, m.customers()), ["channel"], "collections_at_risk",
        ),
        same_result(
            "ap_view",
            metric_query(ap_view(paid, m.suppliers()), ["payment_category"], ["ap_paid_vs_plan"])
            .withColumnRenamed("ap_paid_vs_plan", "cash_out_vs_plan"),
            worksheet.ap_components(paid), ["payment_category"], "cash_out_vs_plan",
        ),
    ]
    # Each view's total is its driver's.
    now = {"forecast_run_date": m.as_of, "driver": "INVENTORY_TRAP"}
    totals = [
        (metric_query(held, [], ["aged_inventory_cost"]), "aged_inventory_cost", "INVENTORY_TRAP"),
        (metric_query(_owed_view(m), [], ["collections_at_risk"]), "collections_at_risk", "COLLECTIONS_SLOWDOWN"),
        (metric_query(ap_view(paid, m.suppliers()), [], ["ap_paid_vs_plan"], {"actual_pay_date": lambda c: c <= F.lit(m.as_of)}),
         "ap_paid_vs_plan", "AP_ACCELERATION"),
    ]
    ties = [
        same_result(
            f"{driver.lower()}_total", found.selectExpr(f"'{driver}' AS driver", f"-{value} AS v"),
            metric_query(cash, ["driver"], ["cash_vs_plan_variance"], now | {"driver": driver})
            .withColumnRenamed("cash_vs_plan_variance", "v"), ["driver"], "v",
        )
        for found, value, driver in totals
    ]
    return stacked([checks, *pairs, *ties, _booked_once(m, ledger)])


@query
def q_briefing(m: Model) -> DataFrame:
    forecast, rates = stage(m.forecast(), "forecast"), stage(_rates(m), "rates")
    return briefing(
        quarter_end_totals(forecast, m.as_of, m.prior_run, m.quarter_end),
        _cycle(m),
        actions.cancel_orders(m.purchase_orders(with_order_date=False), m.products(), rates, m.as_of, WEAK_RATE),
        actions.defer_payments(m.payables(after=m.as_of), m.suppliers(), m.as_of, m.quarter_end),
        actions.chase_collections(m.receivables(False), m.customers(), m.as_of),
        _moves(m),
    )
