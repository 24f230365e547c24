"""KPIs that span several facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import TOTAL, ratio_sql, total
from cashtide.functions.dates import date_sql, open_as_of, trailing
from cashtide.operators.star import Lookup, aggregate_by_attributes, at_latest, side_by_side, sums


def deterioration(forecast: DataFrame, quarter_end: dt.date) -> DataFrame:
    """How far quarter-end cash moved from each forecast run to the next; the first run has no row."""
    runs = (
        forecast.filter(f"forecast_week_ending = {date_sql(quarter_end)}")
        .groupBy("forecast_run_date")
        .agg(total("projected_cash_amt").alias("now"))
    )
    # One row per run by now, so an unpartitioned window is small at any scale.
    return (
        runs.selectExpr("*", "lag(now) OVER (ORDER BY forecast_run_date) AS before")
        .filter("before IS NOT NULL")
        .selectExpr(
            "forecast_run_date AS current_run_date",
            "now AS projected_quarter_end_cash",
            "before AS prior_projected_quarter_end_cash",
            f"CAST(now - before AS {TOTAL}) AS deterioration_2wk",
        )
    )


def cycle_inputs(
    sales: DataFrame,
    inventory: DataFrame,
    receivables: DataFrame,
    payables: DataFrame,
    as_of: dt.date,
    days: int = 90,
    latest: dt.date | None = None,
) -> DataFrame:
    """The sums behind the working-capital cycle, in one row."""
    flows = sales.filter(trailing("date_key", as_of, days)).agg(
        total("net_sales_amt").alias("net_sales"), total("cogs_amt").alias("cogs")
    )
    stock = at_latest(inventory, "week_ending_date", latest).agg(total("on_hand_cost").alias("ending_inventory_cost"))
    owed = receivables.filter(open_as_of("invoice_date", "paid_date", as_of)).agg(
        total("amount").alias("outstanding_ar")
    )
    paid = payables.filter(trailing("actual_pay_date", as_of, days)).agg(
        total("invoice_amt").alias("paid_amt"),
        total("invoice_amt * (terms_days - days_early)").alias("paid_amt_days"),
    )
    return side_by_side([flows, stock, owed, paid])


def working_capital_cycle(
    sales: DataFrame,
    inventory: DataFrame,
    receivables: DataFrame,
    payables: DataFrame,
    as_of: dt.date,
    days: int = 90,
    latest: dt.date | None = None,
) -> DataFrame:
    """Days of sales outstanding, payables, inventory, and the cash conversion cycle, as of a day."""
    inputs = cycle_inputs(sales, inventory, receivables, payables, as_of, days, latest)
    dso = ratio_sql("outstanding_ar", f"(CAST(net_sales AS DOUBLE) / {float(days)}D)")
    dio = ratio_sql("ending_inventory_cost", f"(CAST(cogs AS DOUBLE) / {float(days)}D)")
    return inputs.selectExpr(
        f"{dso} AS dso", f"{ratio_sql('paid_amt_days', 'paid_amt')} AS dpo", f"{dio} AS dio"
    ).selectExpr(
        "round(dso, 1) AS dso_days",
        "round(dpo, 1) AS dpo_days",
        "round(dio, 1) AS dio_days",
        "round(dso + dio - dpo, 1) AS ccc_days",
    )


def units_by_category(sales: DataFrame, products: DataFrame, as_of: dt.date, weeks: int = 8) -> DataFrame:
    """Units sold in the weeks that end with ``as_of``, by department and category."""
    return _by_category(sales.filter(trailing("date_key", as_of, 7 * weeks)), products, "units_sold", "units_8wk")


def _by_category(fact: DataFrame, products: DataFrame, units: str, name: str) -> DataFrame:
    grouped = aggregate_by_attributes(
        fact,
        [Lookup("product", products, "product_id", "product_id")],
        [("department", "product.department"), ("category", "product.category")],
        sums(**{name: units}),
        how="inner",
    )
    return grouped.selectExpr("department", "category", f"CAST({name} AS BIGINT) AS {name}")


def sell_through(
    sales: DataFrame, inventory: DataFrame, products: DataFrame, latest: dt.date, weeks: int = 8
) -> DataFrame:
    """Sell-through and weeks of supply by category, at the snapshot of ``latest``.

    A category in stock that sold nothing has a sell-through of 0 and no weeks of supply; one that
    sold but holds no stock is left out.
    """
    stock = _by_category(
        at_latest(inventory, "week_ending_date", latest), products, "on_hand_units", "on_hand_units"
    )
    sold = units_by_category(sales, products, latest, weeks)
    units = "coalesce(units_8wk, 0)"
    return stock.join(sold, ["department", "category"], "left").selectExpr(
        "department",
        "category",
        "on_hand_units",
        f"{units} AS units_sold_8wk",
        f"{ratio_sql(units, f'({units} + on_hand_units)', 3)} AS sell_through_rate",
        f"{ratio_sql('on_hand_units', f'(CAST(units_8wk AS DOUBLE) / {float(weeks)}D)', 1)} AS weeks_of_supply",
    )
