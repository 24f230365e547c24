"""The five metric views.

Fixed values: names, sources, filters, display names, synonyms and formats of fields and measures.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from cashtide.operators.star import Lookup
from cashtide.plans.metrics import Composed, Field, Measure, MetricView

_USD = "currency USD, 0 decimals"
_PERCENT = "percentage, 1 decimal"


def cash_forecast_view(forecast: DataFrame, quarter_end: dt.date) -> MetricView:
    at_end = f"fact.forecast_week_ending = DATE'{quarter_end}'"
    return MetricView(
        "mv_cash_forecast",
        forecast,
        filter="driver IS NOT NULL",
        fields=(
            Field("forecast_run_date", "fact.forecast_run_date", "Forecast Run Date", ("run date", "as-of date")),
            Field("forecast_week_ending", "fact.forecast_week_ending", "Forecast Week Ending"),
            Field("driver", "fact.driver", "Cash Driver", ("shortfall driver", "cause", "root cause")),
        ),
        measures=(
            Measure("projected_cash", "sum", "projected_cash_amt", label="Projected Cash", format=_USD),
            Measure("planned_cash", "sum", "planned_cash_amt", label="Planned Cash", format=_USD),
            Measure(
                "cash_variance", "sum", "variance_amt",
                label="Cash Variance vs Plan", synonyms=("variance", "shortfall"), format=_USD,
            ),
            Measure(
                "projected_quarter_end_cash", "sum", "projected_cash_amt", at_end,
                label="Projected Quarter-End Cash",
                synonyms=("projected cash at quarter end", "year-end cash"), format=_USD,
            ),
            Measure(
                "planned_quarter_end_cash", "sum", "planned_cash_amt", at_end,
                label="Planned Quarter-End Cash", format=_USD,
            ),
            Measure(
                "cash_vs_plan_variance", "sum", "variance_amt", at_end,
                label="Quarter-End Cash vs Plan", synonyms=("quarter end shortfall", "gap to plan"), format=_USD,
            ),
        ),
        latest_by="forecast_week_ending",
        latest=quarter_end,
        comment="Plan and projection by forecast run, week and driver; a level, by default that of quarter-end.",
    )


def ar_view(invoices: DataFrame, customers: DataFrame, as_of: dt.date, channel: str = "fact.channel") -> MetricView:
    """``channel`` may be ``customer.channel``, for invoices that do not hold it; they are then summed by customer first."""
    overdue = f"fact.status IN ('OPEN', 'DISPUTED', 'SLIPPED') AND fact.due_date < DATE'{as_of}'"
    return MetricView(
        "mv_ar",
        invoices,
        lookups=(Lookup("customer", customers, "customer_id", "customer_id"),),
        fields=(
            Field("channel", channel, "Channel", ("ar channel",)),
            Field("status", "fact.status", "Invoice Status"),
            Field("dispute_reason", "fact.dispute_reason", "Dispute Reason"),
            Field("flipped_last_2wk", "fact.flipped_last_2wk", "Flipped To Disputed Last 2 Weeks"),
            Field("customer_name", "customer.customer_name", "Customer", ("account",)),
            Field("segment", "customer.segment", "Customer Segment"),
            Field("customer_region", "customer.region", "Customer Region"),
            Field("invoice_date", "fact.invoice_date", "Invoice Date"),
            Field("due_date", "fact.due_date", "Due Date"),
            Field("expected_cash_date", "fact.expected_cash_date", "Expected Cash Date"),
        ),
        measures=(
            Measure("total_ar", "sum", "amount", label="Total AR", format=_USD),
            Measure(
                "collections_at_risk", "sum", "cash_impact_vs_plan_amt",
                label="Collections At Risk", synonyms=("cash at risk in AR", "receivables shortfall"), format=_USD,
            ),
            Measure("disputed_ar", "sum", "amount", "fact.dispute_flag", label="Disputed AR", format=_USD),
            Measure("overdue_ar", "sum", "amount", overdue, label="Overdue AR", format=_USD),
            Measure("invoice_count", "count", label="Invoice Count"),
        ),
        comment="Invoices with dispute and settlement detail.",
    )


def ap_view(payments: DataFrame, suppliers: DataFrame) -> MetricView:
    return MetricView(
        "mv_ap",
        payments,
        lookups=(Lookup("supplier", suppliers, "supplier_id", "supplier_id"),),
        fields=(
            Field("payment_category", "fact.payment_category", "Payment Category", ("normal or accelerated",)),
            Field("supplier_name", "supplier.supplier_name", "Supplier"),
            Field("supplier_category", "supplier.category", "Supplier Category"),
            Field("supplier_country", "supplier.country", "Sourcing Country"),
            Field("scheduled_pay_date", "fact.scheduled_pay_date", "Scheduled Pay Date"),
            Field("actual_pay_date", "fact.actual_pay_date", "Actual Pay Date"),
        ),
        measures=(
            Measure("total_ap_paid", "sum", "invoice_amt", label="Total AP Paid", format=_USD),
            Measure(
                "ap_paid_vs_plan", "sum", "cash_impact_vs_plan_amt",
                label="AP Cash Out vs Plan", synonyms=("extra cash out in AP", "payables acceleration"), format=_USD,
            ),
            Measure(
                "early_pay_discount_lost", "sum", "early_pay_discount_lost_amt",
                label="Early-Pay Discount Lost", format=_USD,
            ),
            Measure("surcharge_paid", "sum", "surcharge_amt", label="Tariff/Freight Surcharge Paid", format=_USD),
            Measure(
                "expedite_freight_paid", "sum", "expedite_freight_amt",
                label="Expedited Freight Paid", format=_USD,
            ),
            Measure("avg_days_early", "avg", "days_early", label="Avg Days Paid Early"),
        ),
        comment="Supplier payments and what paying early costs.",
    )


def inventory_view(
    snapshot: DataFrame,
    products: DataFrame,
    stores: DataFrame,
    latest: dt.date | None = None,
    builder: Callable[[Sequence[dt.date]], DataFrame] | None = None,
    weeks: Sequence[dt.date] = (),
) -> MetricView:
    return MetricView(
        "mv_inventory",
        snapshot,
        lookups=(
            Lookup("product", products, "product_id", "product_id"),
            Lookup("store", stores, "store_id", "store_id"),
        ),
        fields=(
            Field("department", "product.department", "Department"),
            Field("category", "product.category", "Category"),
            Field("subcategory", "product.subcategory", "Subcategory"),
            Field("season", "product.season", "Season"),
            Field("region", "store.region", "Region"),
            Field("location_type", "store.location_type", "Location Type"),
            Field("store_name", "store.store_name", "Location"),
            Field("week_ending_date", "fact.week_ending_date", "Week Ending"),
            Field("aging_bucket", "fact.aging_bucket", "Aging Bucket"),
            Field("is_aged", "fact.is_aged", "Is Aged 90+"),
        ),
        measures=(
            Measure(
                "on_hand_cost", "sum", "on_hand_cost",
                label="On-Hand Inventory At Cost", synonyms=("cash in inventory", "inventory value"), format=_USD,
            ),
            Measure(
                "aged_inventory_cost", "sum", "on_hand_cost", "fact.is_aged",
                label="Aged Inventory (90+) At Cost",
                synonyms=("trapped inventory cash", "old inventory value"), format=_USD,
            ),
            Measure(
                "markdown_liability", "sum", "markdown_liability_amt", label="Markdown Liability", format=_USD
            ),
            Measure("on_hand_units", "sum", "on_hand_units", type="bigint", label="On-Hand Units"),
            Composed(
                "inventory_aged_pct",
                "CAST(aged_inventory_cost AS DOUBLE) / nullif(CAST(on_hand_cost AS DOUBLE), 0)",
                ("aged_inventory_cost", "on_hand_cost"),
                label="Inventory Aged %", synonyms=("percent aged", "share of inventory aged"), format=_PERCENT,
            ),
        ),
        latest_by="week_ending_date",
        latest=latest,
        builder=builder,
        weeks=tuple(weeks),
        comment="Weekly stock at cost, its age and its expected markdown.",
    )


def sales_view(sales: DataFrame, products: DataFrame, stores: DataFrame) -> MetricView:
    return MetricView(
        "mv_sales",
        sales,
        lookups=(
            Lookup("product", products, "product_id", "product_id"),
            Lookup("store", stores, "store_id", "store_id"),
        ),
        fields=(
            Field("department", "product.department", "Department"),
            Field("category", "product.category", "Category"),
            Field("season", "product.season", "Season"),
            Field("region", "store.region", "Region"),
            Field("location_type", "store.location_type", "Location Type"),
            Field("store_name", "store.store_name", "Location"),
            Field("date_key", "fact.date_key", "Date"),
        ),
        measures=(
            Measure("net_sales", "sum", "net_sales_amt", label="Net Sales", format=_USD),
            Measure("gross_sales", "sum", "gross_sales_amt", label="Gross Sales", format=_USD),
            Measure("units_sold", "sum", "units_sold", type="bigint", label="Units Sold"),
            Measure("cogs", "sum", "cogs_amt", label="COGS", format=_USD),
            Measure("discount", "sum", "discount_amt", label="Discount / Markdown", format=_USD),
        ),
        comment="Sales by day, product and location.",
    )
