"""The twelve model tables: names, types and column comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Table names, column names and column types of the data model.
_LAYOUT = {
    "dim_date": (
        "One row per calendar day, through the forecast horizon",
        """
        date_key date | the day
        day_of_month int | 1 to 31
        month_num int | 1 to 12
        month_name string | full month name
        quarter_num int | 1 to 4
        year_num int | calendar year
        fiscal_quarter string | label such as FY2026-Q4
        fiscal_year int | equals the calendar year
        week_of_year int | ISO week number
        week_ending_date date | Saturday that closes the week
        day_of_week string | Mon to Sun
        is_weekend boolean | Saturday or Sunday
        is_quarter_end boolean | last day of a quarter
        """,
    ),
    "dim_product": (
        "One row per stock-keeping unit",
        """
        product_id string | key
        sku string | stock-keeping code
        product_name string | display name
        department string | top merchandise level
        category string | second merchandise level
        subcategory string | third merchandise level
        season string | collection; NULL for core goods
        is_seasonal boolean | exposed to markdowns
        unit_cost decimal(10,2) | landed cost of a unit
        unit_price decimal(10,2) | list price of a unit
        primary_supplier_id string | main supplier
        """,
    ),
    "dim_store": (
        "One row per store, distribution centre or online channel",
        """
        store_id string | key
        store_name string | display name
        location_type string | STORE, DC or ECOM
        region string | sales region
        state string | NULL for online
        city string | NULL for online
        open_date date | first trading day
        """,
    ),
    "dim_customer": (
        "One row per account that is invoiced",
        """
        customer_id string | key
        customer_name string | display name
        channel string | WHOLESALE, MARKETPLACE or BNPL
        segment string | kind of account
        region string | region of the account
        credit_terms_days int | agreed days to pay
        onboarded_date date | first day as a customer
        """,
    ),
    "dim_supplier": (
        "One row per supplier",
        """
        supplier_id string | key
        supplier_name string | display name
        category string | what is supplied
        country string | country of origin
        default_terms_days int | agreed days to pay
        early_pay_discount_pct decimal(5,2) | discount for paying early
        region string | region of origin
        """,
    ),
    "fact_sales": (
        "Sales by product, location and day; only combinations that sold",
        """
        sale_id string | key
        date_key date | day of sale
        product_id string | product sold
        store_id string | selling location
        units_sold int | units
        gross_sales_amt decimal(12,2) | before discount
        discount_amt decimal(12,2) | discount or markdown
        net_sales_amt decimal(12,2) | gross less discount
        cogs_amt decimal(12,2) | units at cost
        """,
    ),
    "fact_inventory_snapshot": (
        "Stock by product, location and week; never add it up over weeks",
        """
        snapshot_id string | key
        week_ending_date date | Saturday of the snapshot
        product_id string | product held
        store_id string | holding location
        on_hand_units int | units held
        on_hand_cost decimal(28,2) | units at cost
        last_receipt_date date | newest receipt
        days_on_hand int | days since the newest receipt
        aging_bucket string | 0-30, 31-60, 61-90 or 90+
        is_aged boolean | in the 90+ band
        markdown_liability_amt decimal(28,2) | expected markdown on this stock
        """,
    ),
    "fact_purchase_orders": (
        "One row per purchase order line",
        """
        po_id string | order
        po_line_id string | line of the order
        supplier_id string | supplier
        product_id string | product ordered
        order_date date | day of the order
        expected_receipt_date date | after today: still inbound
        status string | OPEN, RECEIVED or CANCELLED
        ordered_units int | units
        committed_cost decimal(12,2) | cash committed
        is_expedited boolean | rushed
        freight_mode string | OCEAN or AIR
        tariff_surcharge_amt decimal(12,2) | surcharge on the line
        """,
    ),
    "fact_ap_payments": (
        "One row per supplier payment",
        """
        payment_id string | key
        supplier_id string | paid supplier
        po_id string | order paid for
        invoice_amt decimal(12,2) | invoice
        scheduled_pay_date date | due under the agreed terms
        actual_pay_date date | paid
        terms_days int | terms applied
        days_early int | scheduled less actual day
        early_pay_discount_offered_amt decimal(12,2) | discount on offer
        early_pay_discount_captured_amt decimal(12,2) | discount taken
        early_pay_discount_lost_amt decimal(12,2) | discount forfeited
        surcharge_amt decimal(12,2) | tariff or freight surcharge
        expedite_freight_amt decimal(12,2) | rushed freight
        cash_impact_vs_plan_amt decimal(12,2) | extra cash out against plan
        payment_category string | NORMAL or ACCELERATED
        """,
    ),
    "fact_ar_invoices": (
        "One row per customer invoice",
        """
        invoice_id string | key
        customer_id string | invoiced account
        channel string | WHOLESALE, MARKETPLACE or BNPL
        invoice_date date | issued
        due_date date | due
        amount decimal(12,2) | invoice
        paid_date date | NULL while unpaid
        status string | PAID, OPEN, DISPUTED or SLIPPED
        dispute_flag boolean | in dispute
        dispute_reason string | NULL when undisputed
        expected_cash_date date | cash now expected
        cash_impact_vs_plan_amt decimal(12,2) | cash that misses quarter-end
        flipped_last_2wk boolean | newly disputed
        """,
    ),
    "fact_cash_ledger": (
        "Cash in and out by day and category",
        """
        ledger_date date | day
        cash_category string | kind of flow
        cash_in_amt decimal(28,2) | in
        cash_out_amt decimal(28,2) | out
        net_cash_amt decimal(28,2) | in less out
        running_cash_balance decimal(28,2) | balance at the end of the day, the same on each of its rows
        """,
    ),
    "fact_cash_forecast": (
        "Plan and projection by forecast run, week and driver; a level, never added up over weeks",
        """
        forecast_run_date date | day the forecast was made
        forecast_week_ending date | day forecast
        driver string | BASELINE, INVENTORY_TRAP, COLLECTIONS_SLOWDOWN or AP_ACCELERATION
        planned_cash_amt decimal(28,2) | plan
        projected_cash_amt decimal(28,2) | projection
        variance_amt decimal(28,2) | projection less plan
        """,
    ),
}

# The trade tables the model is derived from.
_TRADE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

FACT_DATES = {
    "fact_sales": "date_key",
    "fact_inventory_snapshot": "week_ending_date",
    "fact_purchase_orders": "order_date",
    "fact_ap_payments": "actual_pay_date",
    "fact_ar_invoices": "invoice_date",
    "fact_cash_ledger": "ledger_date",
    "fact_cash_forecast": "forecast_week_ending",
}


_TYPES = {
    "date": T.DateType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp_ntz": T.TimestampNTZType(),
    **{f"decimal({p},2)": T.DecimalType(p, 2) for p in (5, 10, 12, 28)},
}


def _schema(layout: str) -> T.StructType:
    fields = []
    for line in layout.strip().splitlines():
        declared, comment = (part.strip() for part in line.split("|"))
        name, kind = declared.split()
        fields.append(T.StructField(name, _TYPES[kind], True, {"comment": comment}))
    return T.StructType(fields)


TABLE_COMMENTS = {name: comment for name, (comment, _) in _LAYOUT.items()}
SCHEMAS = {name: _schema(layout) for name, (_, layout) in _LAYOUT.items()}
TRADE_SCHEMAS = {
    name: T.StructType([T.StructField(c, _TYPES[kind]) for c, kind in (part.split() for part in columns.split(", "))])
    for name, columns in _TRADE.items()
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: cast, in order, commented, absent ones NULL."""
    present = set(df.columns)
    return df.select(
        *(
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata)
            for f in schema.fields
        )
    )
