"""The model tables as views over trade tables (orders, line items, parts, accounts, places).

Every builder is lazy and joins only what the asked columns need. Lookups are many-to-one LEFT
joins; a line item without its order has no day and is left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import MONEY, RATE, TOTAL, total, total_sql
from cashtide.functions.dates import calendar, date_sql, day_sql, saturdays, trailing_sql
from cashtide.operators.ordered import daily_balance
from cashtide.operators.projection import BASELINE, forecast_rows
from cashtide.operators.snapshot import inventory_snapshot, valued_snapshot
from cashtide.operators.star import Lookup, aggregate_by_attributes, salted_lookup, sums, unique_by
from cashtide.session import stage
from cashtide.sources.tables import stacked

# How many weekly snapshots are kept.
SNAPSHOT_WEEKS = 12
# Days to pay, by the remainder of a supplier's key.
_TERMS = (30, 45, 60)

_GROSS = f"CAST(l_extendedprice AS {MONEY})"
_SHIPPED = day_sql("l_shipdate")
_ORDERED = day_sql("o_orderdate")


class Model:
    """Model tables over the given source tables, for one as-of day and quarter-end."""

    def __init__(self, source: Mapping[str, DataFrame], as_of: dt.date, quarter_end: dt.date):
        self.source = source
        self.as_of = as_of
        self.quarter_end = quarter_end
        self.prior_run = as_of - dt.timedelta(days=14)
        self._stock: tuple[set[dt.date], DataFrame] | None = None

    def with_stock(self, weeks: Sequence[dt.date]) -> Model:
        """This model with the snapshots of these weeks worked out once and written down, for all that read them."""
        model = Model(self.source, self.as_of, self.quarter_end)
        model._stock = set(weeks), stage(self.inventory(weeks), "stock")
        return model

    # dimensions -------------------------------------------------------------------------------

    def dates(self) -> DataFrame:
        """The calendar from the first order to the quarter-end, or the last shipment if later."""
        first = self.source["orders"].agg(F.expr(f"min({_ORDERED}) AS first_day"))
        last = self.source["lineitem"].agg(F.expr(f"max({_SHIPPED}) AS last_day"))
        bounds = first.unionByName(last, allowMissingColumns=True).agg(
            F.expr("min(first_day) AS first_day"),
            F.expr(f"greatest(max(last_day), {date_sql(self.quarter_end)}) AS last_day"),
        )
        return calendar(bounds)

    def products(self) -> DataFrame:
        price = "CAST(p_retailprice AS DECIMAL(10,2))"
        return self.source["part"].selectExpr(
            "p_partkey AS product_id",
            "p_name AS product_name",
            "p_type AS department",
            "p_brand AS category",
            "concat('size ', p_size) AS subcategory",
            # Large goods are the seasonal ones; core goods have no season.
            "CASE WHEN p_size > 25 THEN element_at(array('SPRING', 'SUMMER', 'FALL', 'WINTER'), p_size % 4 + 1) END AS season",
            "p_size > 25 AS is_seasonal",
            f"{price} AS unit_price",
            f"CAST(round({price} * 0.50BD, 2) AS DECIMAL(10,2)) AS unit_cost",
        )

    def _places(self) -> DataFrame:
        places = self.source["nation"].join(self.source["region"], F.expr("n_regionkey = r_regionkey"), "left")
        return places.select("n_nationkey", "n_name", "r_name")

    def stores(self) -> DataFrame:
        return self._places().selectExpr(
            "n_nationkey AS store_id",
            "n_name AS store_name",
            "CASE n_nationkey % 5 WHEN 0 THEN 'DC' WHEN 1 THEN 'ECOM' ELSE 'STORE' END AS location_type",
            "r_name AS region",
        )

    def customers(self) -> DataFrame:
        placed = self.source["customer"].join(self._places(), F.expr("c_nationkey = n_nationkey"), "left")
        return placed.selectExpr(
            "c_custkey AS customer_id",
            "c_name AS customer_name",
            "c_mktsegment AS channel",
            "n_name AS segment",
            "r_name AS region",
        )

    def suppliers(self) -> DataFrame:
        placed = self.source["supplier"].join(self._places(), F.expr("s_nationkey = n_nationkey"), "left")
        return placed.selectExpr(
            "s_suppkey AS supplier_id",
            "s_name AS supplier_name",
            "r_name AS category",
            "n_name AS country",
            f"{_terms('s_suppkey')} AS default_terms_days",
        )

    def _costs(self) -> DataFrame:
        return unique_by(self.products().select("product_id", "unit_cost"), "product_id")

    # facts ------------------------------------------------------------------------------------

    def sales(self, *columns: str) -> DataFrame:
        """Sales lines; ask only for the columns needed, each saves a join."""
        wanted = columns or (
            "date_key", "product_id", "store_id", "units_sold",
            "gross_sales_amt", "discount_amt", "net_sales_amt", "cogs_amt",
        )
        orders = self.source["orders"].selectExpr("o_orderkey", "o_custkey", f"{_ORDERED} AS date_key")
        if "store_id" in wanted:
            sellers = self.source["customer"].selectExpr("c_custkey", "c_nationkey AS store_id")
            orders = orders.join(unique_by(sellers, "c_custkey"), F.expr("o_custkey = c_custkey"), "left")
        lines = self._priced_lines().join(orders, F.expr("l_orderkey = o_orderkey"))
        if "cogs_amt" in wanted:
            lines = lines.join(self._costs(), "product_id", "left")
            lines = lines.selectExpr("*", f"CAST(units_sold * unit_cost AS {MONEY}) AS cogs_amt")
        return lines.select(*wanted)

    def _priced_lines(self) -> DataFrame:
        """Line items with units, gross, discount and net."""
        return (
            self.source["lineitem"]
            .selectExpr(
                "l_orderkey",
                "l_partkey AS product_id",
                "CAST(l_quantity AS INT) AS units_sold",
                f"{_GROSS} AS gross_sales_amt",
                f"CAST(round({_GROSS} * CAST(l_discount AS {RATE}), 2) AS {MONEY}) AS discount_amt",
            )
            .selectExpr("*", f"CAST(gross_sales_amt - discount_amt AS {MONEY}) AS net_sales_amt")
        )

    @staticmethod
    def invoiced(customer: str) -> str:
        """Whether a customer buys on account: its orders are invoiced and collected, all others are paid at once.

        Every order is one of the two, so that its value comes in once. Each fourth customer has an account.
        """
        return f"coalesce({customer} % 4 = 0, false)"

    def sales_by_day(self, paid_at_once: bool = False) -> DataFrame:
        """Net sales per day, all or those paid at once. Lines add up per order first when orders are too big to broadcast."""
        orders = self.source["orders"]
        if paid_at_once:
            orders = orders.filter(f"NOT ({self.invoiced('o_custkey')})")
        orders = orders.selectExpr("o_orderkey", f"{_ORDERED} AS date_key")
        return aggregate_by_attributes(
            self._priced_lines(),
            [Lookup("orders", orders, "l_orderkey", "o_orderkey")],
            [("date_key", "orders.date_key")],
            sums(net_sales_amt="net_sales_amt"),
            how="inner",
        )

    def receivables(self, with_channel: bool = True, paid_at_once: bool = False) -> DataFrame:
        """Invoices of customers with an account, issued up to the as-of day. The channel is looked up row by row, in salted parts.

        With ``paid_at_once`` the orders of all other customers stand beside them, as claims of theirs do.
        """
        issued = self.source["orders"].filter(f"{_ORDERED} <= {date_sql(self.as_of)}")
        if not paid_at_once:
            issued = issued.filter(self.invoiced("o_custkey"))
        invoices = issued.selectExpr(
            "o_orderkey AS invoice_id",
            "o_custkey AS customer_id",
            f"{_ORDERED} AS invoice_date",
            f"date_add({_ORDERED}, 60) AS due_date",
            f"CAST(o_totalprice AS {MONEY}) AS amount",
            f"if(o_orderstatus = 'F', date_add({_ORDERED}, CAST(55 + o_orderkey % 15 AS INT)), NULL) AS paid_date",
            "CASE WHEN o_orderstatus = 'F' THEN 'PAID' WHEN o_orderstatus = 'O' THEN 'OPEN' "
            "WHEN o_orderkey % 3 = 0 THEN 'SLIPPED' ELSE 'DISPUTED' END AS status",
            f"date_add({_ORDERED}, if(o_orderstatus = 'P', 105, 60)) AS expected_cash_date",
        )
        late = f"status IN ('DISPUTED', 'SLIPPED') AND expected_cash_date > {date_sql(self.quarter_end)}"
        flipped = f"status = 'DISPUTED' AND {trailing_sql('invoice_date', self.as_of, 14)}"
        invoices = invoices.selectExpr(
            "*",
            "status = 'DISPUTED' AS dispute_flag",
            # The three reasons for a dispute.
            "CASE WHEN status = 'DISPUTED' THEN element_at("
            "array('short-ship', 'quality defect', 'pricing discrepancy'), CAST(customer_id % 3 + 1 AS INT)) END "
            "AS dispute_reason",
            f"CAST(if({late}, amount, 0) AS {MONEY}) AS cash_impact_vs_plan_amt",
            f"{flipped} AS flipped_last_2wk",
        )
        if not with_channel:
            return invoices
        channels = self.source["customer"].selectExpr("c_custkey AS customer_id", "c_mktsegment AS channel")
        return salted_lookup(invoices, Lookup("customer", channels, "customer_id", "customer_id"), ["channel"])

    def payables(self, after: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        """Supplier payments; paid early: discount lost, surcharge and rushed freight are the extra cash out.

        Payments made ``after`` one day and ``until`` another can be asked for. They fall between the
        shipment and the longest terms, which bounds the days that have to be read.
        """
        lines = self.source["lineitem"]
        if after is not None:
            lines = lines.filter(f"{_SHIPPED} > {date_sql(after - dt.timedelta(days=max(_TERMS)))}")
        if until is not None:
            lines = lines.filter(f"{_SHIPPED} <= {date_sql(until)}")
        paid = self._payments(lines)
        if after is not None:
            paid = paid.filter(f"actual_pay_date > {date_sql(after)}")
        return paid if until is None else paid.filter(f"actual_pay_date <= {date_sql(until)}")

    def _payments(self, lines: DataFrame) -> DataFrame:
        scheduled = f"date_add({_SHIPPED}, {_terms('l_suppkey')})"

        rushed = "early AND l_linestatus = 'O'"

        def extra(condition: str, share: str) -> str:
            return f"CAST(if({condition}, round({_GROSS} * {share}, 2), 0) AS {MONEY})"

        return (
            lines.selectExpr("*", "l_returnflag = 'R' AS early")
            .selectExpr(
                "l_suppkey AS supplier_id",
                f"{_GROSS} AS invoice_amt",
                f"{scheduled} AS scheduled_pay_date",
                f"date_sub({scheduled}, if(early, 30, 0)) AS actual_pay_date",
                f"{_terms('l_suppkey')} AS terms_days",
                "if(early, 30, 0) AS days_early",
                f"{extra('early', '0.02BD')} AS early_pay_discount_lost_amt",
                f"{extra('early', f'CAST(l_tax AS {RATE})')} AS surcharge_amt",
                f"{extra(rushed, '0.01BD')} AS expedite_freight_amt",
                "if(early, 'ACCELERATED', 'NORMAL') AS payment_category",
            )
            .selectExpr(
                "*",
                "CAST(early_pay_discount_lost_amt + surcharge_amt + expedite_freight_amt "
                f"AS {MONEY}) AS cash_impact_vs_plan_amt",
            )
        )

    def purchase_orders(self, with_order_date: bool = True) -> DataFrame:
        lines = self.source["lineitem"].selectExpr(
            "l_orderkey",
            "l_suppkey AS supplier_id",
            "l_partkey AS product_id",
            f"{_SHIPPED} AS expected_receipt_date",
            f"CASE WHEN l_returnflag = 'A' THEN 'CANCELLED' WHEN {_SHIPPED} > {date_sql(self.as_of)} THEN 'OPEN' "
            "ELSE 'RECEIVED' END AS status",
            "CAST(l_quantity AS INT) AS ordered_units",
        )
        lines = lines.join(self._costs(), "product_id", "left")
        lines = lines.selectExpr("*", f"CAST(ordered_units * unit_cost AS {MONEY}) AS committed_cost")
        if with_order_date:
            placed = self.source["orders"].selectExpr("o_orderkey", f"{_ORDERED} AS order_date")
            lines = lines.join(placed, F.expr("l_orderkey = o_orderkey")).drop("o_orderkey")
        return lines.drop("l_orderkey", "unit_cost")

    def snapshot_weeks(self) -> list[dt.date]:
        return saturdays(self.as_of - dt.timedelta(weeks=SNAPSHOT_WEEKS) + dt.timedelta(days=1), self.as_of)

    def inventory(self, weeks: Sequence[dt.date] | None = None, valued: bool = True) -> DataFrame:
        """Stock per week, product and place: unreturned receipts less sales to date; costs join after the sums."""
        if valued and weeks and self._stock is not None and set(weeks) <= self._stock[0]:
            return self._stock[1].filter(F.col("week_ending_date").isin(*weeks))
        places = self.source["supplier"].selectExpr("s_suppkey", "s_nationkey AS store_id")
        receipts = (
            self.source["lineitem"]
            .filter("l_returnflag = 'N'")
            .selectExpr(
                "l_suppkey",
                "l_partkey AS product_id",
                f"{_SHIPPED} AS receipt_date",
                "CAST(l_quantity AS INT) AS units",
            )
        )
        snapshot = inventory_snapshot(
            receipts,
            weeks or self.snapshot_weeks(),
            [Lookup("place", places, "l_suppkey", "s_suppkey")],
            [("product_id", "fact.product_id"), ("store_id", "place.store_id")],
            self.sales("date_key", "product_id", "store_id", "units_sold").withColumnRenamed("units_sold", "units"),
        )
        return valued_snapshot(snapshot, self.products()) if valued else snapshot

    def _flows(self) -> DataFrame:
        paid = self.receivables(False).filter("paid_date IS NOT NULL")
        flows = stacked(
            [
                _flow(self.sales_by_day(paid_at_once=True), "date_key", "SALES_RECEIPTS", "net_sales_amt", None),
                _flow(paid, "paid_date", "WHOLESALE_COLLECTIONS", "amount", None),
                _flow(self.payables(), "actual_pay_date", "SUPPLIER_PAYMENTS", None, "invoice_amt"),
            ]
        ).selectExpr("*", f"CAST(cash_in_amt - cash_out_amt AS {TOTAL}) AS net_cash_amt")
        return flows

    def ledger(self) -> DataFrame:
        """Cash by day and category; each flow is a sum per day before the flows meet."""
        return daily_balance(self._flows(), "ledger_date", "net_cash_amt", name="running_cash_balance")

    def cash_balance(self, end: dt.date) -> DataFrame:
        """``(v)``: net cash up to a day, one row per kind of flow, without its history."""
        limit = date_sql(end)
        sold = self.sales_by_day(paid_at_once=True).filter(f"date_key <= {limit}").agg(total("net_sales_amt").alias("v"))
        paid = self.receivables(False).filter(f"paid_date <= {limit}").agg(total("amount").alias("v"))
        out = self.payables(until=end).agg(total("-invoice_amt").alias("v"))
        return stacked([sold, paid, out])

    def forecast_amounts(self, runs: Sequence[dt.date] | None = None) -> DataFrame:
        """Plan and projection at quarter-end by run and driver, one aggregation per fact for all runs.

        The baseline is one balance, at the as-of day, for every run.
        """
        runs = sorted(runs or [self.prior_run, self.as_of])
        owed = self.receivables(False).filter(f"cash_impact_vs_plan_amt > 0 AND invoice_date <= {date_sql(runs[-1])}")
        paid = self.payables(until=runs[-1]).filter("days_early > 0")
        trap = (
            self.inventory(runs)
            .filter("is_aged")
            .groupBy(F.expr("week_ending_date AS forecast_run_date"))
            .agg(F.expr("'INVENTORY_TRAP' AS driver"), total("on_hand_cost").alias("v"))
        )
        slow = _per_run(owed, runs, "COLLECTIONS_SLOWDOWN", lambda run: f"invoice_date <= {date_sql(run)}")
        early = _per_run(paid, runs, "AP_ACCELERATION", lambda run: f"actual_pay_date <= {date_sql(run)}")
        dates = ", ".join(map(date_sql, runs))
        base = self.cash_balance(self.as_of).agg(F.expr("sum(v) AS v")).selectExpr(
            f"explode(array({dates})) AS forecast_run_date", "v"
        )
        # Each run has a row for its stock, aged or not.
        blank = f"named_struct('driver', 'INVENTORY_TRAP', 'v', CAST(0 AS {TOTAL}))"
        base = base.selectExpr(
            "forecast_run_date", f"inline(array(named_struct('driver', '{BASELINE}', 'v', CAST(v AS {TOTAL})), {blank}))"
        )
        rows = stacked([base, trap, slow, early]).groupBy("forecast_run_date", "driver").agg(
            F.expr(f"coalesce({total_sql('v')}, CAST(0 AS {TOTAL})) AS v")
        )
        return rows.selectExpr(
            "forecast_run_date",
            "driver",
            f"CAST(if(driver = '{BASELINE}', v, 0) AS {TOTAL}) AS planned_amt",
            f"CAST(if(driver = '{BASELINE}', v, -v) AS {TOTAL}) AS projected_amt",
        )

    def forecast(self, runs: Sequence[dt.date] | None = None) -> DataFrame:
        return forecast_rows(self.forecast_amounts(runs), self.quarter_end, self.quarter_end)

    def counted(self) -> dict[str, DataFrame]:
        """Frames with as many rows as ``tables``, without the lookups and values that only add columns."""
        lines = self.sales("date_key")
        return {
            "dim_date": self.dates(),
            "dim_product": self.source["part"],
            "dim_store": self.source["nation"],
            "dim_customer": self.source["customer"],
            "dim_supplier": self.source["supplier"],
            "fact_sales": lines,
            "fact_inventory_snapshot": self.inventory(valued=False),
            "fact_purchase_orders": lines,
            "fact_ap_payments": self.source["lineitem"],
            "fact_ar_invoices": self.receivables(False),
            "fact_cash_ledger": self._flows(),
            "fact_cash_forecast": self.forecast(),
        }

    def tables(self) -> dict[str, DataFrame]:
        """All twelve, by their names."""
        return {
            "dim_date": self.dates(),
            "dim_product": self.products(),
            "dim_store": self.stores(),
            "dim_customer": self.customers(),
            "dim_supplier": self.suppliers(),
            "fact_sales": self.sales(),
            "fact_inventory_snapshot": self.inventory(),
            "fact_purchase_orders": self.purchase_orders(),
            "fact_ap_payments": self.payables(),
            "fact_ar_invoices": self.receivables(),
            "fact_cash_ledger": self.ledger(),
            "fact_cash_forecast": self.forecast(),
        }


def _terms(supplier: str) -> str:
    return f"CASE {supplier} % 3 WHEN 0 THEN {_TERMS[0]} WHEN 1 THEN {_TERMS[1]} ELSE {_TERMS[2]} END"


def _flow(df: DataFrame, date: str, category: str, cash_in: str | None, cash_out: str | None) -> DataFrame:
    sides = {"cash_in_amt": cash_in, "cash_out_amt": cash_out}
    return df.groupBy(F.expr(f"{date} AS ledger_date")).agg(
        F.expr(f"'{category}' AS cash_category"),
        *(F.expr(f"{total_sql(side) if side else f'CAST(0 AS {TOTAL})'} AS {name}") for name, side in sides.items()),
    )


def _per_run(df: DataFrame, runs: Sequence[dt.date], driver: str, counted) -> DataFrame:
    """One sum of cash impact per run, all in one pass, as rows ``(forecast_run_date, driver, v)``."""
    wide = df.agg(*(total("cash_impact_vs_plan_amt", counted(run)).alias(f"v{n}") for n, run in enumerate(runs)))
    entries = ", ".join(
        f"named_struct('forecast_run_date', {date_sql(run)}, 'driver', '{driver}', 'v', v{n})"
        for n, run in enumerate(runs)
    )
    return wide.selectExpr(f"inline(array({entries}))")
