"""Small hand-made model tables whose totals are known.

Fixed values: dates, driver amounts and totals of the worked example.
"""

import datetime as dt
from decimal import Decimal

from cashtide.schemas import SCHEMAS, conform

AS_OF = dt.date(2026, 11, 5)
PRIOR = dt.date(2026, 10, 22)
QUARTER_END = dt.date(2026, 12, 31)
HORIZON = dt.date(2027, 1, 2)
LATEST = dt.date(2026, 10, 31)

PLAN = Decimal(30_000_000)
DRIVER_AMOUNTS = {
    AS_OF: {"INVENTORY_TRAP": 3_500_000, "COLLECTIONS_SLOWDOWN": 2_500_000, "AP_ACCELERATION": 2_000_000},
    PRIOR: {"INVENTORY_TRAP": 3_000_000, "COLLECTIONS_SLOWDOWN": 1_000_000, "AP_ACCELERATION": 1_000_000},
}
TARGETS = {
    "aged_inventory": Decimal(3_500_000),
    "disputed_receivables": Decimal(1_700_000),
    "slipped_receivables": Decimal(800_000),
    "collections_total": Decimal(2_500_000),
    "accelerated_payments": Decimal(2_000_000),
    "drivers_total": Decimal(8_000_000),
    "plan_at_quarter_end": Decimal(30_000_000),
    "projected_at_quarter_end": Decimal(22_000_000),
    "prior_projected_at_quarter_end": Decimal(25_000_000),
    "deterioration": Decimal(3_000_000),
}


def amounts(spark):
    data = []
    for run, drivers in DRIVER_AMOUNTS.items():
        data.append((run, "BASELINE", PLAN, PLAN))
        data += [(run, driver, Decimal(0), Decimal(-value)) for driver, value in drivers.items()]
    return spark.createDataFrame(
        data, "forecast_run_date date, driver string, planned_amt decimal(28,2), projected_amt decimal(28,2)"
    )


def _frame(spark, table, columns, data):
    types = {f.name: f.dataType.simpleString() for f in SCHEMAS[table].fields}
    converted = [
        tuple(Decimal(str(v)) if types[c].startswith("decimal") and v is not None else v for c, v in zip(columns, r, strict=True))
        for r in data
    ]
    return conform(spark.createDataFrame(converted, ", ".join(f"{c} {types[c]}" for c in columns)), SCHEMAS[table])


def d(text):
    return dt.date.fromisoformat(text)


def products(spark):
    return _frame(spark, "dim_product", ["product_id", "product_name", "department", "category", "subcategory", "season", "unit_cost", "unit_price"], [
        ("P1", "Parka", "Women's", "Outerwear", "Coats", "FW25", 50, 100),
        ("P2", "Tee", "Men's", "Tops", "Tees", None, 5, 20),
        ("P3", "Boot", "Footwear", "Boots", "Boots", None, 30, 90),
        ("P4", "Belt", "Accessories", "Belts", "Belts", None, 4, 16),
    ])


def stores(spark):
    return _frame(spark, "dim_store", ["store_id", "store_name", "location_type", "region", "state"], [
        ("S1", "Alpha", "STORE", "West", "CA"), ("S2", "Beta", "STORE", "South", "TX"), ("E1", "Online", "ECOM", "National", None),
    ])


def customers(spark):
    return _frame(spark, "dim_customer", ["customer_id", "customer_name", "channel", "segment", "region", "credit_terms_days"], [
        ("C1", "Acme", "WHOLESALE", "Department store", "West", 60),
        ("C2", "Bolt", "WHOLESALE", "Boutique", "South", 60),
        ("C3", "Mart", "MARKETPLACE", "Marketplace", "National", 14),
    ])


def suppliers(spark):
    return _frame(spark, "dim_supplier", ["supplier_id", "supplier_name", "category", "country", "default_terms_days"], [
        ("V1", "Mill", "Outerwear", "Vietnam", 60), ("V2", "Loom", "Fabric", "Peru", 45),
    ])


def sales(spark):
    columns = ["sale_id", "date_key", "product_id", "store_id", "units_sold", "gross_sales_amt", "discount_amt", "net_sales_amt", "cogs_amt"]
    return _frame(spark, "fact_sales", columns, [
        ("1", d("2026-10-31"), "P1", "S1", 10, 1000, 100, 900, 500),
        ("2", d("2026-09-06"), "P1", "S2", 5, 500, 0, 500, 250),
        ("3", d("2026-09-05"), "P1", "S2", 50, 5000, 0, 5000, 2500),
        ("4", d("2026-10-01"), "P2", "E1", 40, 800, 0, 800, 200),
        ("5", d("2026-08-07"), "P2", "E1", 1000, 20000, 0, 20000, 5000),
        ("6", d("2026-10-15"), "P4", "S1", 3, 48, 0, 48, 12),
    ])


def inventory(spark):
    columns = ["snapshot_id", "week_ending_date", "product_id", "store_id", "on_hand_units", "on_hand_cost",
               "last_receipt_date", "days_on_hand", "aging_bucket", "is_aged", "markdown_liability_amt"]
    return _frame(spark, "fact_inventory_snapshot", columns, [
        ("1", LATEST, "P1", "S1", 35, 3_000_000, d("2026-07-01"), 122, "90+", True, 1_350_000),
        ("2", LATEST, "P1", "S2", 10, 500_000, d("2026-07-02"), 121, "90+", True, 225_000),
        ("3", LATEST, "P2", "S1", 60, 300, d("2026-10-20"), 11, "0-30", False, 15),
        ("4", LATEST, "P3", "S1", 7, 210, d("2026-09-20"), 41, "31-60", False, 10.5),
        ("5", d("2026-10-24"), "P2", "S1", 99, 495, d("2026-10-20"), 4, "0-30", False, 24.75),
    ])


def payables(spark):
    columns = ["payment_id", "supplier_id", "invoice_amt", "scheduled_pay_date", "actual_pay_date", "terms_days", "days_early",
               "early_pay_discount_lost_amt", "surcharge_amt", "expedite_freight_amt", "cash_impact_vs_plan_amt", "payment_category"]
    return _frame(spark, "fact_ap_payments", columns, [
        ("1", "V1", 3_000_000, d("2026-11-20"), d("2026-10-21"), 60, 30, 250_000, 250_000, 200_000, 1_500_000, "ACCELERATED"),
        ("2", "V2", 1_000_000, d("2026-11-15"), d("2026-10-16"), 60, 30, 100_000, 100_000, 100_000, 500_000, "ACCELERATED"),
        ("3", "V1", 1_000_000, d("2026-10-01"), d("2026-10-01"), 60, 0, 0, 0, 0, 0, "NORMAL"),
        ("4", "V1", 9_000_000, d("2026-08-07"), d("2026-08-07"), 45, 0, 0, 0, 0, 0, "NORMAL"),
        ("5", "V2", 700, d("2027-01-10"), d("2026-12-11"), 45, 30, 14, 0, 0, 14, "ACCELERATED"),
    ])


def receivables(spark):
    columns = ["invoice_id", "customer_id", "channel", "invoice_date", "due_date", "amount", "paid_date", "status", "dispute_flag",
               "dispute_reason", "expected_cash_date", "cash_impact_vs_plan_amt", "flipped_last_2wk"]
    late = d("2027-01-20")
    return _frame(spark, "fact_ar_invoices", columns, [
        ("1", "C1", "WHOLESALE", d("2026-09-01"), d("2026-10-31"), 1_000_000, None, "DISPUTED", True, "short-ship", late, 1_000_000, True),
        ("2", "C1", "WHOLESALE", d("2026-09-02"), d("2026-11-01"), 500_000, None, "DISPUTED", True, "short-ship", late, 500_000, False),
        ("3", "C2", "WHOLESALE", d("2026-09-03"), AS_OF, 200_000, None, "DISPUTED", True, "quality defect", late, 200_000, False),
        ("4", "C3", "MARKETPLACE", d("2026-10-10"), d("2026-10-24"), 800_000, None, "SLIPPED", False, None, late, 800_000, False),
        ("5", "C2", "WHOLESALE", d("2026-08-01"), d("2026-09-30"), 400, None, "OPEN", False, None, d("2026-12-01"), 0, False),
        ("6", "C2", "WHOLESALE", d("2026-06-01"), d("2026-07-31"), 999, d("2026-08-02"), "PAID", False, None, d("2026-08-02"), 0, False),
        ("7", "C2", "WHOLESALE", d("2026-10-01"), d("2026-11-30"), 600, None, "OPEN", False, None, d("2026-12-01"), 0, False),
    ])


def purchase_orders(spark):
    columns = ["po_id", "po_line_id", "supplier_id", "product_id", "order_date", "expected_receipt_date", "status", "ordered_units", "committed_cost"]
    return _frame(spark, "fact_purchase_orders", columns, [
        ("1", "1", "V1", "P1", d("2026-06-01"), d("2026-11-20"), "OPEN", 100, 5000),
        ("2", "1", "V1", "P1", d("2026-06-01"), d("2026-12-01"), "OPEN", 50, 2500),
        ("3", "1", "V2", "P2", d("2026-06-01"), d("2026-11-20"), "OPEN", 10, 50),
        ("4", "1", "V1", "P1", d("2026-06-01"), d("2026-11-01"), "OPEN", 7, 350),
        ("5", "1", "V1", "P1", d("2026-01-01"), d("2026-02-15"), "RECEIVED", 20, 1000),
        ("6", "1", "V1", "P1", d("2026-01-01"), d("2026-12-15"), "CANCELLED", 30, 1500),
    ])
