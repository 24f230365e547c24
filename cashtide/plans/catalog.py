"""Tables, KPI views, metric views and worksheet questions under the names their users know."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.plans import worksheet as sheet
from cashtide.plans.kpis import deterioration, sell_through, working_capital_cycle
from cashtide.plans.metric_views import ap_view, ar_view, cash_forecast_view, inventory_view, sales_view
from cashtide.plans.metrics import MetricView, metric_query
from cashtide.schemas import FACT_DATES
from cashtide.sources.tables import date_ranges, register_views, table_counts


def kpi_views(tables: Mapping[str, DataFrame], as_of: dt.date, quarter_end: dt.date, latest: dt.date) -> dict[str, DataFrame]:
    sales, stock = tables["fact_sales"], tables["fact_inventory_snapshot"]
    return {
        "v_cash_forecast_deterioration": deterioration(tables["fact_cash_forecast"], quarter_end),
        "v_working_capital_cycle": working_capital_cycle(
            sales, stock, tables["fact_ar_invoices"], tables["fact_ap_payments"], as_of, latest=latest
        ),
        "v_inventory_sell_through": sell_through(sales, stock, tables["dim_product"], latest),
    }


def metric_views(tables: Mapping[str, DataFrame], as_of: dt.date, quarter_end: dt.date, latest: dt.date | None = None) -> dict[str, MetricView]:
    views = (
        cash_forecast_view(tables["fact_cash_forecast"], quarter_end),
        ar_view(tables["fact_ar_invoices"], tables["dim_customer"], as_of),
        ap_view(tables["fact_ap_payments"], tables["dim_supplier"]),
        inventory_view(tables["fact_inventory_snapshot"], tables["dim_product"], tables["dim_store"], latest),
        sales_view(tables["fact_sales"], tables["dim_product"], tables["dim_store"]),
    )
    return {view.name: view for view in views}


def register(tables: Mapping[str, DataFrame], as_of: dt.date, quarter_end: dt.date, latest: dt.date) -> dict[str, MetricView]:
    """Name all tables and KPI views in the session; returns the metric views, for ``metric_query``."""
    register_views({**tables, **kpi_views(tables, as_of, quarter_end, latest)})
    return metric_views(tables, as_of, quarter_end, latest)


def worksheet(
    tables: Mapping[str, DataFrame], as_of: dt.date, quarter_end: dt.date, latest: dt.date
) -> dict[str, Callable[[], DataFrame]]:
    """The sixteen worksheet questions by name; a question is planned when it is called."""
    t = tables
    views = metric_views(tables, as_of, quarter_end, latest)
    kpis = kpi_views(tables, as_of, quarter_end, latest)
    ranged = ("fact_sales", "fact_cash_ledger", "fact_cash_forecast")

    def measured(view: str, dims: list[str], measure: str, where: Mapping | None = None, ascending: bool = False) -> DataFrame:
        found = metric_query(views[view], dims, [measure], where)
        return found.orderBy(measure) if ascending else found.orderBy(F.desc(measure))

    return {
        "row_counts": lambda: table_counts(t),
        "date_ranges": lambda: date_ranges({name: (t[name], FACT_DATES[name]) for name in ranged}),
        "plan_vs_projected": lambda: sheet.plan_vs_projected(t["fact_cash_forecast"], quarter_end),
        "deterioration": lambda: kpis["v_cash_forecast_deterioration"],
        "driver_variance": lambda: sheet.driver_variance(t["fact_cash_forecast"], as_of, quarter_end),
        "sell_through": lambda: kpis["v_inventory_sell_through"].orderBy("sell_through_rate"),
        "aged_inventory": lambda: sheet.aged_inventory(t["fact_inventory_snapshot"], t["dim_product"], latest),
        "po_by_status": lambda: sheet.po_by_status(t["fact_purchase_orders"]),
        "collections_by_channel": lambda: sheet.collections_by_channel(t["fact_ar_invoices"]),
        "disputes": lambda: sheet.disputes(t["fact_ar_invoices"], t["dim_customer"]),
        "ap_components": lambda: sheet.ap_components(t["fact_ap_payments"]),
        "working_capital": lambda: kpis["v_working_capital_cycle"],
        "view_cash": lambda: measured(
            "mv_cash_forecast", ["driver"], "cash_vs_plan_variance", {"forecast_run_date": as_of}, True
        ),
        "view_inventory": lambda: measured(
            "mv_inventory", ["department", "category"], "aged_inventory_cost",
            {"week_ending_date": latest, "is_aged": True},
        ),
        "view_ar": lambda: measured("mv_ar", ["channel"], "collections_at_risk"),
        "view_ap": lambda: measured("mv_ap", ["payment_category"], "ap_paid_vs_plan"),
    }
