"""The registered queries in DuckDB SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from statistics import NormalDist

AS_OF = "DATE '2001-06-30'"
QUARTER_END = "DATE '2001-09-30'"
PRIOR_RUN = "DATE '2001-06-16'"
MONEY = "DECIMAL(12,2)"
TOTAL = "DECIMAL(28,2)"


def _total(value: str, where: str | None = None) -> str:
    return f"CAST(sum({value}){f' FILTER (WHERE {where})' if where else ''} AS {TOTAL})"


def _zero(value: str) -> str:
    return f"CAST(coalesce({value}, 0) AS {TOTAL})"


def _saturday(d: str) -> str:
    return f"({d} + CAST((13 - isodow({d})) % 7 AS INT))"


def _portion(amount: str, part: str, whole: str) -> str:
    """amount * part / whole to the cent, halves away from zero."""
    cents = f"CAST(abs({amount}) * 100 AS HUGEINT)"
    quotient = f"((2 * {cents} * CAST({part} AS HUGEINT) + CAST({whole} AS HUGEINT)) // (2 * CAST({whole} AS HUGEINT)))"
    return (
        f"CAST(CAST(CASE WHEN {amount} < 0 THEN -1 ELSE 1 END * {quotient} AS DECIMAL(24,0))"
        f" * CAST(0.01 AS DECIMAL(3,2)) AS {TOTAL})"
    )


def _band(value: str, bounds: tuple[int, ...], labels: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {value} <= {b} THEN '{label}'" for b, label in zip(bounds, labels, strict=False))
    return f"CASE {whens} WHEN {value} > {bounds[-1]} THEN '{labels[-1]}' END"


# Common table expressions: name -> (needs, text).
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "product": (
        (),
        """SELECT p_partkey AS product_id, p_name AS product_name, p_type AS department, p_brand AS category,
             'size ' || p_size AS subcategory,
             CASE WHEN p_size > 25 THEN ['SPRING', 'SUMMER', 'FALL', 'WINTER'][p_size % 4 + 1] END AS season,
             CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price,
             CAST(round(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.50 AS DECIMAL(3,2)), 2) AS DECIMAL(10,2)) AS unit_cost
           FROM part""",
    ),
    "place": ((), "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "store": (
        ("place",),
        """SELECT n_nationkey AS store_id, n_name AS store_name, r_name AS region,
             CASE n_nationkey % 5 WHEN 0 THEN 'DC' WHEN 1 THEN 'ECOM' ELSE 'STORE' END AS location_type FROM place""",
    ),
    "account": (
        ("place",),
        """SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS channel, n_name AS segment,
             r_name AS region FROM customer LEFT JOIN place ON c_nationkey = n_nationkey""",
    ),
    "vendor": (
        ("place",),
        """SELECT s_suppkey AS supplier_id, s_name AS supplier_name, r_name AS category, n_name AS country, s_nationkey,
             CASE s_suppkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 45 ELSE 60 END AS default_terms_days
           FROM supplier LEFT JOIN place ON s_nationkey = n_nationkey""",
    ),
    "sales": (
        ("product",),
        f"""SELECT CAST(o_orderdate AS DATE) AS date_key, l_partkey AS product_id, c_nationkey AS store_id, o_custkey % 4 = 0 AS invoiced,
              CAST(l_quantity AS INT) AS units_sold, CAST(l_extendedprice AS {MONEY}) AS gross_sales_amt,
              CAST(round(CAST(l_extendedprice AS {MONEY}) * CAST(l_discount AS DECIMAL(4,2)), 2) AS {MONEY}) AS discount_amt,
              CAST(CAST(l_extendedprice AS {MONEY})
                - CAST(round(CAST(l_extendedprice AS {MONEY}) * CAST(l_discount AS DECIMAL(4,2)), 2) AS {MONEY})
                AS {MONEY}) AS net_sales_amt,
              CAST(CAST(l_quantity AS INT) * unit_cost AS {MONEY}) AS cogs_amt
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN product ON l_partkey = product_id""",
    ),
    "invoice": (
        (),
        f"""SELECT i.*, c_mktsegment AS channel,
              status = 'DISPUTED' AS dispute_flag,
              CASE WHEN status = 'DISPUTED' THEN CASE customer_id % 3 WHEN 0 THEN 'short-ship'
                WHEN 1 THEN 'quality defect' ELSE 'pricing discrepancy' END END AS dispute_reason,
              CAST(CASE WHEN status IN ('DISPUTED', 'SLIPPED') AND expected_cash_date > {QUARTER_END}
                THEN amount ELSE 0 END AS {MONEY}) AS cash_impact_vs_plan_amt,
              status = 'DISPUTED' AND invoice_date > {AS_OF} - 14 AND invoice_date <= {AS_OF} AS flipped_last_2wk
            FROM (SELECT o_orderkey AS invoice_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS invoice_date,
                CAST(o_orderdate AS DATE) + 60 AS due_date, CAST(o_totalprice AS {MONEY}) AS amount,
                CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(55 + o_orderkey % 15 AS INT) END AS paid_date,
                CASE WHEN o_orderstatus = 'F' THEN 'PAID' WHEN o_orderstatus = 'O' THEN 'OPEN'
                  WHEN o_orderkey % 3 = 0 THEN 'SLIPPED' ELSE 'DISPUTED' END AS status,
                CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'P' THEN 105 ELSE 60 END AS expected_cash_date
              FROM orders WHERE CAST(o_orderdate AS DATE) <= {AS_OF} AND o_custkey % 4 = 0) i LEFT JOIN customer ON customer_id = c_custkey""",
    ),
    "payment": (
        (),
        f"""SELECT *, CAST(early_pay_discount_lost_amt + surcharge_amt + expedite_freight_amt AS {MONEY}) AS cash_impact_vs_plan_amt
            FROM (SELECT supplier_id, invoice_amt, ship + terms AS scheduled_pay_date,
                ship + terms - CASE WHEN early THEN 30 ELSE 0 END AS actual_pay_date, terms AS terms_days,
                CASE WHEN early THEN 30 ELSE 0 END AS days_early,
                CAST(CASE WHEN early THEN round(invoice_amt * CAST(0.02 AS DECIMAL(4,2)), 2) ELSE 0 END AS {MONEY}) AS early_pay_discount_lost_amt,
                CAST(CASE WHEN early THEN round(invoice_amt * tax, 2) ELSE 0 END AS {MONEY}) AS surcharge_amt,
                CAST(CASE WHEN early AND l_linestatus = 'O' THEN round(invoice_amt * CAST(0.01 AS DECIMAL(4,2)), 2) ELSE 0 END AS {MONEY}) AS expedite_freight_amt,
                CASE WHEN early THEN 'ACCELERATED' ELSE 'NORMAL' END AS payment_category
              FROM (SELECT l_suppkey AS supplier_id, CAST(l_extendedprice AS {MONEY}) AS invoice_amt, l_linestatus,
                  CAST(l_tax AS DECIMAL(4,2)) AS tax, CAST(l_shipdate AS DATE) AS ship, l_returnflag = 'R' AS early,
                  CASE l_suppkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 45 ELSE 60 END AS terms
                FROM lineitem))""",
    ),
    "po": (
        ("product",),
        f"""SELECT l_suppkey AS supplier_id, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS expected_receipt_date,
              CASE WHEN l_returnflag = 'A' THEN 'CANCELLED' WHEN CAST(l_shipdate AS DATE) > {AS_OF} THEN 'OPEN'
                ELSE 'RECEIVED' END AS status,
              CAST(l_quantity AS INT) AS ordered_units,
              CAST(CAST(l_quantity AS INT) * unit_cost AS {MONEY}) AS committed_cost
            FROM lineitem LEFT JOIN product ON l_partkey = product_id""",
    ),
    "week": (
        (),
        f"SELECT CAST({AS_OF} - CAST(7 * n AS INT) AS DATE) AS week_ending_date FROM range(12) AS r(n)",
    ),
    "stock": (
        ("product", "week", "sales"),
        f"""SELECT s.week_ending_date, s.product_id, s.store_id, s.on_hand_units, s.on_hand_cost, s.last_receipt_date,
              s.days_on_hand, {_band("s.days_on_hand", (30, 60, 90), ("0-30", "31-60", "61-90", "90+"))} AS aging_bucket,
              s.days_on_hand > 90 AS is_aged,
              CAST(round(s.on_hand_cost * CASE WHEN s.days_on_hand > 90 THEN CAST(0.45 AS DECIMAL(4,2))
                ELSE CAST(0.05 AS DECIMAL(4,2)) END, 2) AS {TOTAL}) AS markdown_liability_amt
            FROM (SELECT week_ending_date, product_id, store_id, on_hand_units, last_receipt_date,
                CAST(on_hand_units * unit_cost AS {TOTAL}) AS on_hand_cost,
                date_diff('day', last_receipt_date, week_ending_date) AS days_on_hand
              FROM (SELECT week_ending_date, product_id, store_id, CAST(sum(units) AS BIGINT) AS on_hand_units, max(received) AS last_receipt_date
                FROM week JOIN (
                  SELECT l_partkey AS product_id, s_nationkey AS store_id, CAST(l_quantity AS INT) AS units,
                    CAST(l_shipdate AS DATE) AS received, CAST(l_shipdate AS DATE) AS day
                  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'N'
                  UNION ALL SELECT product_id, store_id, -units_sold, NULL, date_key FROM sales) ON day <= week_ending_date
                GROUP BY ALL HAVING sum(units) > 0 AND max(received) IS NOT NULL)
              LEFT JOIN product USING (product_id)) s""",
    ),
    "latest_stock": (("stock",), f"SELECT * FROM stock WHERE week_ending_date = {AS_OF}"),
    "ledger": (
        ("sales", "invoice", "payment"),
        f"""SELECT ledger_date, cash_category, cash_in_amt, cash_out_amt, CAST(cash_in_amt - cash_out_amt AS {TOTAL}) AS net_cash_amt,
              CAST(day_balance AS {TOTAL}) AS running_cash_balance
            FROM (
              SELECT date_key AS ledger_date, 'SALES_RECEIPTS' AS cash_category, {_total("net_sales_amt")} AS cash_in_amt, CAST(0 AS {TOTAL}) AS cash_out_amt FROM sales WHERE NOT invoiced GROUP BY 1
              UNION ALL SELECT paid_date, 'WHOLESALE_COLLECTIONS', {_total("amount")}, 0 FROM invoice WHERE paid_date IS NOT NULL GROUP BY 1
              UNION ALL SELECT actual_pay_date, 'SUPPLIER_PAYMENTS', 0, {_total("invoice_amt")} FROM payment GROUP BY 1) f
            JOIN (SELECT d, sum(net) OVER (ORDER BY d) AS day_balance FROM (
                SELECT d, sum(net) AS net FROM (
                  SELECT date_key AS d, net_sales_amt AS net FROM sales WHERE NOT invoiced
                  UNION ALL SELECT paid_date, amount FROM invoice WHERE paid_date IS NOT NULL
                  UNION ALL SELECT actual_pay_date, -invoice_amt FROM payment) GROUP BY d)) b ON d = ledger_date""",
    ),
    "daily": (("ledger",), "SELECT DISTINCT ledger_date AS day, running_cash_balance AS balance FROM ledger"),
    "run": ((), f"SELECT unnest([{PRIOR_RUN}, {AS_OF}]) AS run"),
    "profile": (
        ("daily",),
        f"""WITH q AS (
              SELECT quarter, ending, opening FROM (
                SELECT quarter, ending, lag(ending) OVER (ORDER BY quarter) AS opening FROM (
                  SELECT date_trunc('quarter', day)::DATE AS quarter, arg_max(balance, day) AS ending FROM daily WHERE day <= {PRIOR_RUN} GROUP BY 1))
              WHERE opening <> ending AND (quarter + INTERVAL 3 MONTH)::DATE - 1 <= {PRIOR_RUN}),
            come AS (
              SELECT quarter, w, ending - opening AS moved, coalesce((SELECT arg_max(balance, day) FROM daily
                WHERE day >= quarter AND day < (quarter + INTERVAL 3 MONTH)::DATE AND (w = 13 OR day < quarter + CAST(7 * w AS INT))), opening) - opening AS come
              FROM q, range(14) AS r(w)),
            shares AS (
              SELECT w, CASE WHEN come = 0 OR sign(come) <> sign(moved) THEN 0 WHEN abs(come) >= abs(moved) THEN 1000000
                ELSE CAST(abs(come) * 100 AS HUGEINT) * 1000000 // CAST(abs(moved) * 100 AS HUGEINT) END AS share FROM come)
            SELECT CAST(w AS INT) AS week, max(middle) OVER (ORDER BY w) AS reached, quarters
            FROM (SELECT w, CAST(2 * median(CAST(share AS BIGINT)) AS BIGINT) AS middle, count(*) AS quarters FROM shares GROUP BY w)""",
    ),
    "run6": ((), f"SELECT CAST({AS_OF} - CAST(14 * n AS INT) AS DATE) AS run FROM range(6) AS r(n)"),
}


def _level(amount: str) -> str:
    """The path at one of its days: the amount at quarter-end, before it what is there and a part of what is left."""
    return f"CASE WHEN forecast_week_ending = {QUARTER_END} THEN {amount} ELSE opening + {_portion(f'({amount} - opening)', 'part', 'whole')} END"


def _forecast(runs: str) -> str:
    aged = "(SELECT coalesce(sum(on_hand_cost), 0) FROM stock WHERE is_aged AND week_ending_date = run)"
    slow = "(SELECT coalesce(sum(cash_impact_vs_plan_amt), 0) FROM invoice WHERE invoice_date <= run)"
    early = "(SELECT coalesce(sum(cash_impact_vs_plan_amt), 0) FROM payment WHERE actual_pay_date <= run)"
    base = f"(SELECT balance FROM daily WHERE day <= {AS_OF} ORDER BY day DESC LIMIT 1)"
    return f"""SELECT run AS forecast_run_date, week AS forecast_week_ending, driver,
          CASE WHEN driver = 'BASELINE' AND i > 0 THEN {_portion("planned", "(94 * n + 6 * i)", "(100 * n)")} ELSE planned END AS planned_cash_amt,
          CASE WHEN i = 0 THEN projected WHEN driver = 'BASELINE' THEN {_portion("projected", "(94 * n + 6 * i)", "(100 * n)")}
            ELSE {_portion("projected", "i", "n")} END AS projected_cash_amt
        FROM (
          SELECT run, 'BASELINE' AS driver, CAST({base} AS {TOTAL}) AS planned, CAST({base} AS {TOTAL}) AS projected FROM {runs}
          UNION ALL SELECT run, 'INVENTORY_TRAP', 0, CAST(-{aged} AS {TOTAL}) FROM {runs}
          UNION ALL SELECT run, 'COLLECTIONS_SLOWDOWN', 0, CAST(-{slow} AS {TOTAL}) FROM {runs}
          UNION ALL SELECT run, 'AP_ACCELERATION', 0, CAST(-{early} AS {TOTAL}) FROM {runs}) a
        JOIN (
          SELECT run AS r, week, row_number() OVER (PARTITION BY run ORDER BY week) AS i, count(*) OVER (PARTITION BY run) AS n
          FROM (SELECT run, unnest(generate_series(run + 1, {QUARTER_END}, INTERVAL 1 DAY))::DATE AS week FROM {runs}) WHERE isodow(week) = 6
          UNION ALL SELECT run, {QUARTER_END}, 0, 1 FROM {runs}) w ON run = r"""


for _name, _runs in (("forecast", "run"), ("forecast6", "run6")):
    _CTES[_name + "_levels"] = (("stock", "invoice", "payment", "daily", _runs), _forecast(_runs))
    _CTES[_name] = (
        (_name + "_levels",),
        f"SELECT *, CAST(projected_cash_amt - planned_cash_amt AS {TOTAL}) AS variance_amt FROM {_name}_levels",
    )
# Invoices, and beside them the orders of customers without an account.
_CTES["claim"] = ((), _CTES["invoice"][1].replace(" AND o_custkey % 4 = 0", ""))
_CTES["at_end"] = (("forecast",), f"SELECT * FROM forecast WHERE forecast_week_ending = {QUARTER_END}")
_CTES["change"] = (
    ("at_end",),
    f"""SELECT * FROM (SELECT forecast_run_date AS current_run_date, projected AS projected_quarter_end_cash,
          lag(projected) OVER (ORDER BY forecast_run_date) AS prior_projected_quarter_end_cash,
          CAST(projected - lag(projected) OVER (ORDER BY forecast_run_date) AS {TOTAL}) AS deterioration_2wk
        FROM (SELECT forecast_run_date, {_total("projected_cash_amt")} AS projected FROM at_end GROUP BY 1))
      WHERE prior_projected_quarter_end_cash IS NOT NULL""",
)
_CTES["cycle"] = (
    ("sales", "latest_stock", "invoice", "payment"),
    f"""SELECT CAST(ar AS DOUBLE) / (CAST(net AS DOUBLE) / 90.0) AS dso, CAST(days AS DOUBLE) / CAST(paid AS DOUBLE) AS dpo,
          CAST(inv AS DOUBLE) / (CAST(cogs AS DOUBLE) / 90.0) AS dio
        FROM (SELECT sum(net_sales_amt) AS net, sum(cogs_amt) AS cogs FROM sales WHERE date_key > {AS_OF} - 90 AND date_key <= {AS_OF}),
          (SELECT sum(on_hand_cost) AS inv FROM latest_stock),
          (SELECT sum(amount) AS ar FROM invoice WHERE invoice_date <= {AS_OF} AND (paid_date IS NULL OR paid_date > {AS_OF})),
          (SELECT sum(invoice_amt * (terms_days - days_early)) AS days, sum(invoice_amt) AS paid FROM payment
            WHERE actual_pay_date > {AS_OF} - 90 AND actual_pay_date <= {AS_OF})""",
)
_CTES["rate"] = (
    ("sales", "latest_stock", "product"),
    f"""SELECT department, category, on_hand_units, coalesce(sold, 0) AS units_sold_8wk,
          round(CAST(coalesce(sold, 0) AS DOUBLE) / nullif(CAST(coalesce(sold, 0) + on_hand_units AS DOUBLE), 0), 3) AS sell_through_rate,
          round(CAST(on_hand_units AS DOUBLE) / nullif(CAST(sold AS DOUBLE) / 8.0, 0), 1) AS weeks_of_supply
        FROM (SELECT department, category, CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units
            FROM latest_stock JOIN product USING (product_id) GROUP BY 1, 2)
        LEFT JOIN (SELECT department, category, CAST(sum(units_sold) AS BIGINT) AS sold
            FROM sales JOIN product USING (product_id) WHERE date_key > {AS_OF} - 56 AND date_key <= {AS_OF} GROUP BY 1, 2)
          USING (department, category)""",
)
_CTES["cancel"] = (
    ("po", "product", "rate"),
    f"""SELECT product_id, supplier_id, count(*) AS open_lines, CAST(sum(ordered_units) AS BIGINT) AS open_units,
          {_total("committed_cost")} AS committed_cost, min(expected_receipt_date) AS next_receipt_date,
          department, category, sell_through_rate
        FROM po JOIN product USING (product_id) JOIN rate USING (department, category)
        WHERE status = 'OPEN' AND expected_receipt_date > {AS_OF} AND sell_through_rate < 0.5
        GROUP BY product_id, supplier_id, department, category, sell_through_rate""",
)
_CTES["deferral"] = (
    ("payment", "vendor"),
    f"""SELECT supplier_id, count(*) AS payments, {_total("invoice_amt")} AS deferrable_cash,
          {_zero(_total("invoice_amt", f"actual_pay_date <= {QUARTER_END} AND scheduled_pay_date > {QUARTER_END}"))} AS kept_past_quarter_end,
          {_total("cash_impact_vs_plan_amt")} AS avoidable_cost, min(actual_pay_date) AS next_pay_date, supplier_name
        FROM payment LEFT JOIN vendor USING (supplier_id) WHERE days_early > 0 AND actual_pay_date > {AS_OF}
        GROUP BY supplier_id, supplier_name""",
)
_CTES["overdue"] = (
    ("invoice", "account"),
    f"""SELECT customer_id, invoices, overdue_amount, oldest_due_date, days_past_due, customer_name,
          coalesce(paid_invoices, 0) AS paid_invoices, coalesce(paid_on_time, 0) AS paid_on_time, on_time_low,
          CASE WHEN on_time_low IS NULL THEN 'UNKNOWN' WHEN on_time_low >= 0.25 THEN 'HIGH' ELSE 'LOW' END AS confidence,
          CASE WHEN paid_invoices IS NULL THEN 'nothing paid so far' ELSE paid_on_time || ' of ' || paid_invoices || ' paid on time' END AS reason
        FROM (SELECT customer_id, count(*) AS invoices, {_total("amount")} AS overdue_amount, min(due_date) AS oldest_due_date,
            CAST(date_diff('day', min(due_date), {AS_OF}) AS INT) AS days_past_due
          FROM invoice WHERE status = 'OPEN' AND due_date < {AS_OF} GROUP BY customer_id)
        LEFT JOIN (SELECT customer_id, customer_name FROM account) USING (customer_id)
        LEFT JOIN (SELECT customer_id, n AS paid_invoices, k AS paid_on_time,
            round((p + 3.8416 / 2 / n - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 4) AS on_time_low
          FROM (SELECT customer_id, count(*) AS n, count(*) FILTER (WHERE paid_date <= due_date) AS k,
              CAST(count(*) FILTER (WHERE paid_date <= due_date) AS DOUBLE) / count(*) AS p
            FROM invoice WHERE paid_date <= {AS_OF} GROUP BY customer_id)) USING (customer_id)""",
)
_CTES["over"] = (
    ("latest_stock", "sales"),
    f"""SELECT product_id, store_id, CAST(coalesce(held, 0) - (coalesce(sold, 0) * 6 + 7) // 8 AS BIGINT) AS over
        FROM (SELECT product_id, store_id, on_hand_units AS held FROM latest_stock)
        FULL JOIN (SELECT product_id, store_id, sum(units_sold) AS sold FROM sales
            WHERE date_key > {AS_OF} - 56 AND date_key <= {AS_OF} GROUP BY 1, 2) USING (product_id, store_id)""",
)
_CTES["laid"] = (
    ("over",),
    """SELECT product_id, store_id, over > 0 AS gives, abs(over) AS units,
         sum(abs(over)) OVER (PARTITION BY product_id, over > 0 ORDER BY abs(over) DESC, store_id
           ROWS UNBOUNDED PRECEDING) AS stop FROM over WHERE over <> 0""",
)
_CTES["move"] = (
    ("laid",),
    """SELECT g.product_id, g.store_id AS from_store_id, t.store_id AS to_store_id,
         CAST(least(g.stop, t.stop) - greatest(g.stop - g.units, t.stop - t.units) AS BIGINT) AS units
       FROM laid g JOIN laid t ON g.product_id = t.product_id AND g.gives AND NOT t.gives
         AND g.stop > t.stop - t.units AND t.stop > g.stop - g.units""",
)
_CTES["trend"] = (
    ("ledger",),
    f"""SELECT *, dxy / dxx AS slope, (CAST(sy AS DOUBLE) - (dxy / dxx) * sx) / n AS intercept,
          sqrt(greatest(0.0, dyy - dxy * dxy / dxx) / n / (n - 2)) AS spread
        FROM (SELECT *, CAST(n * sxx - sx * sx AS DOUBLE) AS dxx, CAST(n * sxy - sx * sy AS DOUBLE) AS dxy,
            CAST(n * syy - sy * sy AS DOUBLE) AS dyy
          FROM (SELECT segment, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy
            FROM (SELECT segment, CAST(date_diff('day', {AS_OF}, day) AS HUGEINT) AS x, CAST(round(balance, 0) AS HUGEINT) AS y
              FROM (SELECT segment, day, sum(net) OVER (PARTITION BY segment ORDER BY day) AS balance
                FROM (SELECT 'ALL' AS segment, ledger_date AS day, sum(net_cash_amt) AS net FROM ledger WHERE ledger_date <= {AS_OF} GROUP BY ALL
                  UNION ALL SELECT cash_category, ledger_date, net_cash_amt FROM ledger WHERE ledger_date <= {AS_OF})))
            GROUP BY segment))""",
)


def _projected(points: str, where: str = "true") -> str:
    """Point, lower and upper bound for each date of a relation ``points(d)``."""
    z = repr(NormalDist().inv_cdf(0.975))
    return f"""SELECT segment, d AS forecast_date, CAST(round(mid, 0) AS {TOTAL}) AS projected_balance,
          CAST(round(mid - width, 0) AS {TOTAL}) AS lower_bound, CAST(round(mid + width, 0) AS {TOTAL}) AS upper_bound
        FROM (SELECT segment, d, intercept + slope * x AS mid,
            CAST({z} AS DOUBLE) * spread * sqrt(1 + CAST(1.0 AS DOUBLE) / n + (x - CAST(sx AS DOUBLE) / n) * (x - CAST(sx AS DOUBLE) / n) / (dxx / n)) AS width
          FROM (SELECT *, CAST(date_diff('day', {AS_OF}, d) AS DOUBLE) AS x FROM trend, {points} WHERE {where}))"""


def _sql(body: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for needed in _CTES[name][0]:
                visit(needed)
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    # Tables used several times are worked out once.
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({_CTES[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{body}"


_CALENDAR = f"""SELECT d AS date_key, CAST(day(d) AS INT) AS day_of_month, CAST(month(d) AS INT) AS month_num,
      strftime(d, '%B') AS month_name, CAST(quarter(d) AS INT) AS quarter_num, CAST(year(d) AS INT) AS year_num,
      'FY' || year(d) || '-Q' || quarter(d) AS fiscal_quarter, CAST(year(d) AS INT) AS fiscal_year,
      CAST(weekofyear(d) AS INT) AS week_of_year, {_saturday("d")} AS week_ending_date, strftime(d, '%a') AS day_of_week,
      isodow(d) >= 6 AS is_weekend, d = last_day(d) AND month(d) % 3 = 0 AS is_quarter_end
    FROM (SELECT unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders),
      (SELECT greatest(max(CAST(l_shipdate AS DATE)), {QUARTER_END}) FROM lineitem), INTERVAL 1 DAY))::DATE AS d)"""

_COUNTED = {
    "dim_date": f"({_CALENDAR})",
    "dim_product": "product",
    "dim_store": "store",
    "dim_customer": "account",
    "dim_supplier": "vendor",
    "fact_sales": "sales",
    "fact_inventory_snapshot": "stock",
    "fact_purchase_orders": "po",
    "fact_ap_payments": "payment",
    "fact_ar_invoices": "invoice",
    "fact_cash_ledger": "ledger",
    "fact_cash_forecast": "forecast",
}

_CASH_MEASURES = f"""{_total("projected_cash_amt")} AS projected_cash, {_total("planned_cash_amt")} AS planned_cash,
    {_total("variance_amt")} AS cash_variance,
    {_total("projected_cash_amt", f"forecast_week_ending = {QUARTER_END}")} AS projected_quarter_end_cash,
    {_total("planned_cash_amt", f"forecast_week_ending = {QUARTER_END}")} AS planned_quarter_end_cash,
    {_total("variance_amt", f"forecast_week_ending = {QUARTER_END}")} AS cash_vs_plan_variance"""

_AGED = f"""SELECT department, category, {_total("on_hand_cost")} AS aged_on_hand_cost, {_total("markdown_liability_amt")} AS markdown_liability
    FROM latest_stock JOIN product USING (product_id) WHERE is_aged GROUP BY 1, 2"""

_RISK = f"""SELECT channel, {_total("cash_impact_vs_plan_amt")} AS collections_at_risk, count(*) AS invoices,
      count(*) FILTER (WHERE flipped_last_2wk) AS flipped_last_2wk
    FROM invoice WHERE cash_impact_vs_plan_amt > 0 GROUP BY channel"""

_LEVELS = f"""SELECT {_total("planned_cash_amt", f"forecast_run_date = {AS_OF}")} AS plan,
      {_total("projected_cash_amt", f"forecast_run_date = {AS_OF}")} AS projected,
      {_total("projected_cash_amt", f"forecast_run_date = {PRIOR_RUN}")} AS prior,
      {_total("variance_amt", f"forecast_run_date = {AS_OF} AND driver = 'INVENTORY_TRAP'")} AS inv,
      {_total("variance_amt", f"forecast_run_date = {AS_OF} AND driver = 'COLLECTIONS_SLOWDOWN'")} AS coll,
      {_total("variance_amt", f"forecast_run_date = {AS_OF} AND driver = 'AP_ACCELERATION'")} AS ap
    FROM at_end"""

# The Spark rules without look-behind and possessive quantifiers, which only save time there.
_RULES = (
    ("amount", r"(?:\$|\b(?i:USD|EUR) ?)[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?", 0, None),
    ("amount", r"[0-9]+(?:[,.][0-9]+)* ?(?i:USD|EUR)\b", 0, None),
    ("terms_days", r"\b(?i:net)[ -]?([0-9]+)", 1, None),
    ("discount_pct", r"([0-9]+(?:\.[0-9]+)?) ?%", 1, None),
    ("reason", r"(?i)short[- ]ship(?:ped|ment)?", 0, "short-ship"),
    ("reason", r"(?i)(?:quality (?:defect|issue)|defective)", 0, "quality defect"),
    ("reason", r"(?i)pric(?:e|ing) (?:discrepancy|difference|error)", 0, "pricing discrepancy"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0, None),
    ("phone", r"\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b", 0, None),
    ("licence", r"(?:MIT License|Apache License|GNU General Public License|Creative Commons)", 0, None),
)


def _found(rule: str, pattern: str, group: int, finding: str | None, table: str = "documents", key: str = "doc_id") -> str:
    hits = f"regexp_extract_all(text, '{pattern}', {group})"
    value = "value" if finding is None else f"'{finding}'"
    return f"""SELECT {key}, '{rule}' AS rule, CAST(occurrence AS INT) AS occurrence, {value} AS value
      FROM (SELECT {key}, unnest({hits}) AS value, generate_subscripts({hits}, 1) AS occurrence FROM {table})"""


_EVIDENCE = " UNION ALL ".join(_found(*rule) for rule in _RULES)
_MESSAGES = " UNION ALL ".join(_found(*rule, "conversations", "conv_id, turn") for rule in _RULES)

ORACLE_SQL: dict[str, str] = {
    "q_table_counts": _sql(
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {r}" for t, r in _COUNTED.items()),
        *(r for r in _COUNTED.values() if r in _CTES),
    ),
    "q_fact_date_ranges": _sql(
        """SELECT 'fact_sales' AS fact, min(date_key) AS from_date, max(date_key) AS to_date FROM sales
           UNION ALL SELECT 'fact_cash_ledger', min(ledger_date), max(ledger_date) FROM ledger
           UNION ALL SELECT 'fact_cash_forecast', min(forecast_week_ending), max(forecast_week_ending) FROM forecast""",
        "sales", "ledger", "forecast",
    ),
    "q_calendar": _CALENDAR,
    "q_sales_valued": _sql(
        f"""SELECT date_key, store_id, CAST(sum(units_sold) AS BIGINT) AS units_sold,
              {", ".join(f"{_total(c)} AS {c}" for c in ("gross_sales_amt", "discount_amt", "net_sales_amt", "cogs_amt"))}
            FROM sales GROUP BY 1, 2""",
        "sales",
    ),
    "q_id_format": """SELECT p_partkey AS product_id, 'SKU-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS sku,
          'INV-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS snapshot_code FROM part""",
    "q_plan_vs_projected": _sql(
        """SELECT forecast_run_date, CAST(round(sum(planned_cash_amt)) AS BIGINT) AS plan_cash,
             CAST(round(sum(projected_cash_amt)) AS BIGINT) AS projected_cash,
             CAST(round(sum(variance_amt)) AS BIGINT) AS variance FROM at_end GROUP BY 1""",
        "at_end",
    ),
    "q_deterioration": _sql("SELECT * FROM change", "change"),
    "q_driver_variance": _sql(
        f"SELECT driver, {_total('variance_amt')} AS variance FROM at_end WHERE forecast_run_date = {AS_OF} GROUP BY 1",
        "at_end",
    ),
    "q_sell_through": _sql("SELECT * FROM rate", "rate"),
    "q_aged_inventory": _sql(_AGED, "latest_stock", "product"),
    "q_po_by_status": _sql(
        f"SELECT status, count(*) AS po_lines, {_total('committed_cost')} AS committed_cost FROM po GROUP BY 1", "po"
    ),
    "q_collections_by_channel": _sql(_RISK, "invoice"),
    "q_disputes": _sql(
        f"""SELECT customer_name, dispute_reason, {_total("amount")} AS disputed_amount, max(flipped_last_2wk) AS flipped_last_2wk
            FROM claim JOIN (SELECT customer_id, customer_name FROM account) USING (customer_id)
            WHERE dispute_flag GROUP BY 1, 2""",
        "claim", "account",
    ),
    "q_ap_components": _sql(
        f"""SELECT payment_category, count(*) AS payments, {_total("cash_impact_vs_plan_amt")} AS cash_out_vs_plan,
              {_total("early_pay_discount_lost_amt")} AS early_pay_discount_lost, {_total("surcharge_amt")} AS tariff_surcharge,
              {_total("expedite_freight_amt")} AS expedited_freight,
              {_total("cash_impact_vs_plan_amt - early_pay_discount_lost_amt - surcharge_amt - expedite_freight_amt")} AS early_payment
            FROM payment GROUP BY 1""",
        "payment",
    ),
    "q_working_capital": _sql(
        """SELECT round(dso, 1) AS dso_days, round(dpo, 1) AS dpo_days, round(dio, 1) AS dio_days,
             round(dso + dio - dpo, 1) AS ccc_days FROM cycle""",
        "cycle",
    ),
    "q_saved_model": _sql(
        """SELECT round(dso, 1) AS dso_days, round(dpo, 1) AS dpo_days, round(dio, 1) AS dio_days,
             round(dso + dio - dpo, 1) AS ccc_days FROM cycle""",
        "cycle",
    ),
    "q_mv_cash": _sql(f"SELECT forecast_run_date, driver, {_CASH_MEASURES} FROM at_end GROUP BY 1, 2", "at_end"),
    "q_mv_cash_weeks": _sql(
        f"""SELECT forecast_week_ending, {_total("projected_cash_amt")} AS projected_cash, {_total("variance_amt")} AS cash_variance
            FROM forecast WHERE forecast_run_date = {AS_OF} GROUP BY 1""",
        "forecast",
    ),
    "q_mv_inventory_two_weeks": _sql(
        f"""SELECT region, CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units, {_total("on_hand_cost")} AS on_hand_cost
            FROM stock LEFT JOIN store USING (store_id) WHERE week_ending_date = {AS_OF} - 7 GROUP BY 1""",
        "stock", "store",
    ),
    "q_mv_inventory_goods": _sql(
        f"""SELECT subcategory, season, location_type, store_name, CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units,
              {_total("on_hand_cost")} AS on_hand_cost
            FROM latest_stock LEFT JOIN product USING (product_id) LEFT JOIN store USING (store_id) GROUP BY 1, 2, 3, 4""",
        "latest_stock", "product", "store",
    ),
    "q_mv_sales_goods": _sql(
        f"""SELECT category, season, {_total("net_sales_amt")} AS net_sales, CAST(sum(units_sold) AS BIGINT) AS units_sold
            FROM sales LEFT JOIN product USING (product_id) GROUP BY 1, 2""",
        "sales", "product",
    ),
    "q_mv_ar_status": _sql(
        f"""SELECT status, dispute_reason, flipped_last_2wk, segment, {_total("amount")} AS total_ar,
              {_total("amount", "dispute_flag")} AS disputed_ar, count(*) AS invoice_count
            FROM invoice LEFT JOIN (SELECT customer_id, segment FROM account) USING (customer_id) GROUP BY 1, 2, 3, 4""",
        "invoice", "account",
    ),
    "q_mv_ar_customers": _sql(
        f"""SELECT customer_name, {_total("amount")} AS total_ar, count(*) AS invoice_count
            FROM invoice LEFT JOIN (SELECT customer_id, customer_name FROM account) USING (customer_id)
            WHERE due_date <= {AS_OF} AND invoice_date > {AS_OF} - 365 AND expected_cash_date <= {QUARTER_END}
              AND status IN ('OPEN', 'SLIPPED') GROUP BY 1""",
        "invoice", "account",
    ),
    "q_mv_ar_dates": _sql(
        f"SELECT invoice_date, due_date, expected_cash_date, {_total('amount')} AS total_ar FROM invoice GROUP BY 1, 2, 3", "invoice"
    ),
    "q_mv_ap_suppliers": _sql(
        f"""SELECT supplier_name, category AS supplier_category, {_total("invoice_amt")} AS total_ap_paid,
              {_total("cash_impact_vs_plan_amt")} AS ap_paid_vs_plan
            FROM payment LEFT JOIN vendor USING (supplier_id) GROUP BY 1, 2""",
        "payment", "vendor",
    ),
    "q_mv_ap_dates": _sql(
        f"SELECT scheduled_pay_date, actual_pay_date, {_total('invoice_amt')} AS total_ap_paid FROM payment GROUP BY 1, 2", "payment"
    ),
    "q_mv_cash_current": _sql(
        f"SELECT driver, {_total('variance_amt')} AS quarter_end_variance FROM at_end WHERE forecast_run_date = {AS_OF} GROUP BY 1",
        "at_end",
    ),
    "q_mv_inventory": _sql(
        f"""SELECT department, category, region, {_total("on_hand_cost")} AS on_hand_cost,
              {_total("on_hand_cost", "is_aged")} AS aged_inventory_cost, {_total("markdown_liability_amt")} AS markdown_liability,
              CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units,
              round(CAST({_total("on_hand_cost", "is_aged")} AS DOUBLE) / nullif(CAST({_total("on_hand_cost")} AS DOUBLE), 0), 4) AS inventory_aged_pct
            FROM latest_stock LEFT JOIN product USING (product_id) LEFT JOIN store USING (store_id) GROUP BY 1, 2, 3""",
        "latest_stock", "product", "store",
    ),
    "q_mv_inventory_weeks": _sql(
        f"""SELECT week_ending_date, aging_bucket, CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units,
              {_total("on_hand_cost")} AS on_hand_cost FROM stock GROUP BY 1, 2""",
        "stock",
    ),
    "q_mv_aged": _sql(f"SELECT department, category, aged_on_hand_cost AS aged_cost FROM ({_AGED})", "latest_stock", "product"),
    "q_mv_ar": _sql(
        f"""SELECT i.channel, a.region AS customer_region, {_total("amount")} AS total_ar,
              {_total("cash_impact_vs_plan_amt")} AS collections_at_risk, {_total("amount", "dispute_flag")} AS disputed_ar,
              {_total("amount", f"status IN ('OPEN', 'DISPUTED', 'SLIPPED') AND due_date < {AS_OF}")} AS overdue_ar,
              count(*) AS invoice_count
            FROM invoice i LEFT JOIN account a USING (customer_id) GROUP BY 1, 2""",
        "invoice", "account",
    ),
    "q_mv_ar_channel": _sql(
        f"SELECT channel, {_total('cash_impact_vs_plan_amt')} AS collections_at_risk FROM invoice GROUP BY 1", "invoice"
    ),
    "q_mv_ap": _sql(
        f"""SELECT payment_category, country AS supplier_country, {_total("invoice_amt")} AS total_ap_paid,
              {_total("cash_impact_vs_plan_amt")} AS ap_paid_vs_plan, {_total("early_pay_discount_lost_amt")} AS early_pay_discount_lost,
              {_total("surcharge_amt")} AS surcharge_paid, {_total("expedite_freight_amt")} AS expedite_freight_paid,
              round(avg(days_early), 4) AS avg_days_early
            FROM payment LEFT JOIN vendor USING (supplier_id) GROUP BY 1, 2""",
        "payment", "vendor",
    ),
    "q_mv_ap_category": _sql(
        f"SELECT payment_category, {_total('cash_impact_vs_plan_amt')} AS ap_cash_out_vs_plan FROM payment GROUP BY 1", "payment"
    ),
    "q_mv_sales": _sql(
        f"""SELECT department, region, location_type, {_total("net_sales_amt")} AS net_sales, {_total("gross_sales_amt")} AS gross_sales,
              CAST(sum(units_sold) AS BIGINT) AS units_sold, {_total("cogs_amt")} AS cogs, {_total("discount_amt")} AS discount
            FROM sales LEFT JOIN product USING (product_id) LEFT JOIN store USING (store_id) GROUP BY 1, 2, 3""",
        "sales", "product", "store",
    ),
    "q_mv_sales_sets": _sql(
        f"""SELECT category, region, grouping(category, region) AS grouping_id, {_total("net_sales_amt")} AS net_sales,
              CAST(sum(units_sold) AS BIGINT) AS units_sold
            FROM sales LEFT JOIN product USING (product_id) LEFT JOIN store USING (store_id)
            GROUP BY GROUPING SETS ((category, region), (category), (region), ())""",
        "sales", "product", "store",
    ),
    "q_mv_inventory_sets": _sql(
        " UNION ALL ".join(
            f"""SELECT {week} AS week_ending_date, {region} AS region, CAST({number} AS BIGINT) AS grouping_id,
                  CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units, {_total("on_hand_cost")} AS on_hand_cost,
                  round(CAST({_total("on_hand_cost", "is_aged")} AS DOUBLE) / nullif(CAST({_total("on_hand_cost")} AS DOUBLE), 0), 4) AS inventory_aged_pct
                FROM {source} LEFT JOIN store s USING (store_id) {grain}"""
            for week, region, number, source, grain in (
                ("week_ending_date", "s.region", 0, "stock", "GROUP BY week_ending_date, s.region"),
                ("week_ending_date", "CAST(NULL AS VARCHAR)", 1, "stock", "GROUP BY week_ending_date"),
                ("CAST(NULL AS DATE)", "s.region", 2, "latest_stock", "GROUP BY s.region"),
                ("CAST(NULL AS DATE)", "CAST(NULL AS VARCHAR)", 3, "latest_stock", ""),
            )
        ),
        "stock", "latest_stock", "store",
    ),
    "q_metric_filtered": _sql(
        f"""SELECT store_name, {_total("net_sales_amt")} AS net_sales, CAST(sum(units_sold) AS BIGINT) AS units_sold
            FROM sales LEFT JOIN store USING (store_id)
            WHERE region IN ('ASIA', 'EUROPE') AND date_key > {AS_OF} - 90 AND date_key <= {AS_OF} GROUP BY 1""",
        "sales", "store",
    ),
    "q_inventory_snapshot": _sql("SELECT * REPLACE (CAST(days_on_hand AS INT) AS days_on_hand) FROM stock", "stock"),
    "q_units_8wk": _sql(
        f"""SELECT department, category, CAST(sum(units_sold) AS BIGINT) AS units_8wk FROM sales JOIN product USING (product_id)
            WHERE date_key > {AS_OF} - 56 AND date_key <= {AS_OF} GROUP BY 1, 2""",
        "sales", "product",
    ),
    "q_allocate_exact": _sql(
        f"""SELECT channel, customer_id, invoiced,
              CAST(share + CASE WHEN last THEN at_risk - sum(share) OVER (PARTITION BY channel) ELSE 0 END AS {TOTAL}) AS allocated
            FROM (SELECT *, {_portion("at_risk", "(invoiced * 100)", "(weight * 100)")} AS share FROM (
              SELECT channel, customer_id, invoiced, sum(invoiced) OVER (PARTITION BY channel) AS weight,
                {_total("risk")[:-len(f" AS {TOTAL})")].replace("CAST(", "", 1)} OVER (PARTITION BY channel) AS at_risk,
                row_number() OVER (PARTITION BY channel ORDER BY customer_id DESC) = 1 AS last
              FROM (SELECT channel, customer_id, {_total("amount")} AS invoiced, sum(cash_impact_vs_plan_amt) AS risk
                FROM invoice GROUP BY 1, 2)))""",
        "invoice",
    ),
    "q_even_split": _sql(
        """SELECT category, product_id, CAST(coalesce(total, 0) // n + CASE WHEN place <= coalesce(total, 0) % n THEN 1 ELSE 0 END AS BIGINT) AS units
           FROM (SELECT category, product_id, count(*) OVER (PARTITION BY category) AS n,
               row_number() OVER (PARTITION BY category ORDER BY product_id) AS place FROM product)
           JOIN (SELECT category, sum(ordered_units) AS total FROM po JOIN product USING (product_id) WHERE status = 'OPEN' GROUP BY 1)
             USING (category)""",
        "product", "po",
    ),
    "q_running_total": _sql(
        f"""SELECT channel, invoice_id, amount,
              CAST(sum(amount) OVER (PARTITION BY channel ORDER BY invoice_id) AS {TOTAL}) AS invoiced_so_far FROM invoice""",
        "invoice",
    ),
    "q_running_total_nulls": _sql(
        f"""SELECT channel, invoice_id, CASE WHEN dispute_flag THEN amount END AS amount,
              CAST(sum(CASE WHEN dispute_flag THEN amount END) OVER (PARTITION BY channel ORDER BY invoice_id) AS {TOTAL}) AS disputed_so_far
            FROM invoice""",
        "invoice",
    ),
    "q_position": _sql(
        "SELECT channel, invoice_id, row_number() OVER (PARTITION BY channel ORDER BY invoice_id) AS place FROM invoice", "invoice"
    ),
    "q_fill_nulls": _sql(
        """SELECT channel, invoice_id, last_value(dispute_reason IGNORE NULLS) OVER (PARTITION BY channel ORDER BY invoice_id
             ROWS UNBOUNDED PRECEDING) AS dispute_reason FROM invoice""",
        "invoice",
    ),
    "q_ledger": _sql("SELECT * FROM ledger", "ledger"),
    "q_category_shares": _sql(
        """SELECT ledger_date, cash_category, direction, amount,
             CAST(sum(amount) OVER (PARTITION BY direction, cash_category ORDER BY ledger_date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE)
             / nullif(CAST(sum(amount) OVER (PARTITION BY direction ORDER BY ledger_date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE), 0) AS share
           FROM (SELECT ledger_date, cash_category, 'IN' AS direction, cash_in_amt AS amount FROM ledger WHERE cash_in_amt <> 0
             UNION ALL SELECT ledger_date, cash_category, 'OUT', cash_out_amt FROM ledger WHERE cash_out_amt <> 0)""",
        "ledger",
    ),
    "q_balance_fill": _sql(
        """SELECT day, coalesce(first_value(noted IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
             last_value(noted IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS balance
           FROM (SELECT day, CASE WHEN isodow(day) = 6 THEN balance END AS noted FROM daily)""",
        "daily",
    ),
    "q_balance_delta": _sql(
        f"SELECT day, balance, CAST(balance - lag(balance) OVER (ORDER BY day) AS {TOTAL}) AS change FROM daily", "daily"
    ),
    "q_week_fraction": _sql(
        f"""SELECT *, round(CAST(ordinal AS DOUBLE) / count(*) OVER (PARTITION BY fiscal_quarter), 4) AS fraction FROM (
              SELECT *, row_number() OVER (PARTITION BY fiscal_quarter ORDER BY week_ending_date) AS ordinal FROM (
                SELECT 'FY' || year(date_key) || '-Q' || quarter(date_key) AS fiscal_quarter, {_saturday("date_key")} AS week_ending_date,
                  {_total("net_sales_amt")} AS net_sales_amt FROM sales GROUP BY 1, 2))""",
        "sales",
    ),
    "q_forecast_rows": _sql("SELECT * FROM forecast", "forecast"),
    "q_quarter_profile": _sql("SELECT * FROM profile", "profile"),
    "q_forecast_path": _sql(
        f"""SELECT forecast_run_date, forecast_week_ending, known AS from_history, CAST(opening AS {TOTAL}) AS opening_balance,
              CAST({_level("planned")} AS {TOTAL}) AS planned_cash_amt, CAST({_level("projected")} AS {TOTAL}) AS projected_cash_amt,
              CAST({_level("projected")} - {_level("planned")} AS {TOTAL}) AS variance_amt
            FROM (
              SELECT *, CASE WHEN known THEN p.reached - p0.reached ELSE forecast_week_ending - forecast_run_date END AS part,
                CASE WHEN known THEN 2000000 - p0.reached ELSE {QUARTER_END} - forecast_run_date END AS whole
              FROM (
                SELECT forecast_run_date, forecast_week_ending, planned, projected,
                  coalesce((SELECT arg_max(balance, day) FROM daily WHERE day <= forecast_run_date), 0) AS opening,
                  greatest(0, least(13, (forecast_run_date - DATE '2001-07-01' + 1) // 7)) AS w0,
                  CASE WHEN forecast_week_ending < DATE '2001-07-01' THEN 0 ELSE least(13, (forecast_week_ending - DATE '2001-07-01' + 1) // 7) END AS w1
                FROM (SELECT DISTINCT forecast_run_date, forecast_week_ending FROM forecast)
                JOIN (SELECT forecast_run_date, sum(planned_cash_amt) AS planned, sum(projected_cash_amt) AS projected FROM at_end GROUP BY 1) USING (forecast_run_date))
              LEFT JOIN profile p0 ON p0.week = w0 LEFT JOIN profile p ON p.week = w1,
              LATERAL (SELECT coalesce(p0.reached < 2000000 AND p.reached IS NOT NULL, false) AS known))""",
        "at_end", "profile",
    ),
    "q_dso_target_ar": _sql(
        f"""SELECT net_sales, target AS outstanding_target, CAST(greatest(250000, target - 2500000) AS {TOTAL}) AS open_target
            FROM (SELECT net_sales, {_portion("net_sales", "45", "90")} AS target FROM (
              SELECT {_total("net_sales_amt")} AS net_sales FROM sales WHERE date_key > {AS_OF} - 90 AND date_key <= {AS_OF}))""",
        "sales",
    ),
    "q_ar_aging": _sql(
        f"""SELECT channel, {_band(f"date_diff('day', due_date, {AS_OF})", (0, 30, 60, 90), ("current", "1-30", "31-60", "61-90", "90+"))} AS past_due_bucket,
              count(*) AS invoices, {_total("amount")} AS open_amount
            FROM invoice WHERE invoice_date <= {AS_OF} AND (paid_date IS NULL OR paid_date > {AS_OF}) GROUP BY 1, 2""",
        "invoice",
    ),
    "q_ap_schedule": _sql(
        f"""SELECT {_saturday("scheduled_pay_date")} AS pay_week, count(*) AS payments, {_total("invoice_amt")} AS scheduled_amt,
              {_zero(_total("invoice_amt", "payment_category = 'ACCELERATED'"))} AS accelerated_amt,
              {_zero(_total("invoice_amt", f"actual_pay_date <= {AS_OF}"))} AS already_paid_amt
            FROM payment WHERE scheduled_pay_date > {AS_OF} GROUP BY 1""",
        "payment",
    ),
    "q_inventory_aging": _sql(
        f"""SELECT department, category, region,
              {_zero(_total("on_hand_cost", "aging_bucket = '0-30'"))} AS days_0_30,
              {_zero(_total("on_hand_cost", "aging_bucket = '31-60'"))} AS days_31_60,
              {_zero(_total("on_hand_cost", "aging_bucket = '61-90'"))} AS days_61_90,
              {_zero(_total("on_hand_cost", "aging_bucket = '90+'"))} AS days_over_90, {_total("on_hand_cost")} AS on_hand_cost
            FROM latest_stock LEFT JOIN product USING (product_id) LEFT JOIN store USING (store_id) GROUP BY 1, 2, 3""",
        "latest_stock", "product", "store",
    ),
    "q_sell_through_gap": _sql(
        """SELECT department, category, sell_through_rate, CAST(0.7 AS DOUBLE) AS plan_rate,
             round(sell_through_rate - CAST(0.7 AS DOUBLE), 3) AS gap FROM rate""",
        "rate",
    ),
    "q_terms_variance": _sql(
        """SELECT supplier_id, supplier_name, payments, invoice_amt, default_terms_days, round(applied / total, 2) AS applied_terms_days,
             round(kept / total, 2) AS kept_terms_days, round(round(kept / total, 2) - default_terms_days, 2) AS variance_days
           FROM (SELECT supplier_id, supplier_name, default_terms_days, count(*) AS payments,
               CAST(sum(invoice_amt) AS DECIMAL(28,2)) AS invoice_amt, nullif(CAST(sum(invoice_amt) AS DOUBLE), 0) AS total,
               CAST(sum(invoice_amt * terms_days) AS DOUBLE) AS applied, CAST(sum(invoice_amt * (terms_days - days_early)) AS DOUBLE) AS kept
             FROM payment LEFT JOIN vendor USING (supplier_id) GROUP BY 1, 2, 3)""",
        "payment", "vendor",
    ),
    "q_waterfall": _sql(
        f"""SELECT CAST(row_number() OVER (ORDER BY section, amount, item) - 1 AS INT) AS step, item, amount,
              CAST(sum(CASE WHEN section = 3 THEN 0 ELSE amount END) OVER (ORDER BY section, amount, item) AS {TOTAL}) AS running
            FROM (SELECT 0 AS section, 'PLAN' AS item, plan AS amount FROM ({_LEVELS})
              UNION ALL SELECT 1, driver, {_total("variance_amt")} FROM at_end WHERE forecast_run_date = {AS_OF} AND driver <> 'BASELINE' GROUP BY driver
              UNION ALL SELECT 2, 'OTHER', CAST(projected - plan - inv - coll - ap AS {TOTAL}) FROM ({_LEVELS})
              UNION ALL SELECT 3, 'PROJECTED', projected FROM ({_LEVELS}))""",
        "at_end",
    ),
    "q_forecast": _sql(
        _projected(f"(SELECT unnest([DATE '2001-07-31', DATE '2001-08-31', {QUARTER_END}]) AS d)"), "trend"
    ),
    "q_forecast_seasonal": _sql(
        f"""SELECT * FROM (WITH points AS (SELECT day, CAST(date_diff('day', {AS_OF} - 364, day) AS HUGEINT) AS x, balance,
              CAST(round(balance, 0) AS HUGEINT) - first_value(CAST(round(balance, 0) AS HUGEINT)) OVER (ORDER BY day) AS y,
              first_value(CAST(round(balance, 0) AS HUGEINT)) OVER (ORDER BY day) AS base
            FROM daily WHERE day <= {AS_OF} AND day > {AS_OF} - 365),
          sums AS (SELECT count(*) AS n, min(base) AS base, sum(x) AS sx, sum(y) AS sy, CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) AS dxx,
              CAST(count(*) * sum(x * y) - sum(x) * sum(y) AS DOUBLE) AS dxy FROM points),
          line AS (SELECT *, dxy / dxx AS slope, CAST(base AS DOUBLE) + (CAST(sy AS DOUBLE) - (dxy / dxx) * sx) / n AS intercept FROM sums),
          away AS (SELECT isodow(day) AS wd, CAST(round(CAST(balance AS DOUBLE) - (intercept + slope * x), 0) AS HUGEINT) AS r FROM points, line),
          effect AS (SELECT wd, count(*) AS m, sum(r) AS s, sum(r * r) AS ss FROM away GROUP BY wd),
          whole AS (SELECT sqrt(greatest(0.0, CAST(sum(ss) AS DOUBLE) - sum(CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / m ORDER BY wd)) / (min(n) - 1 - count(*))) AS spread
            FROM effect, line)
          SELECT 'ALL' AS segment, d AS forecast_date, CAST(round(mid, 0) AS {TOTAL}) AS projected_balance,
            CAST(round(mid - width, 0) AS {TOTAL}) AS lower_bound, CAST(round(mid + width, 0) AS {TOTAL}) AS upper_bound
          FROM (SELECT d, intercept + slope * x + CAST(s AS DOUBLE) / m AS mid, CAST({NormalDist().inv_cdf(0.975)!r} AS DOUBLE) * spread
                * sqrt(1 + CAST(1.0 AS DOUBLE) / n + (x - CAST(sx AS DOUBLE) / n) * (x - CAST(sx AS DOUBLE) / n) / (dxx / n)) AS width
              FROM line, whole, (SELECT CAST({AS_OF} + CAST(k AS INT) AS DATE) AS d, CAST(364 + k AS DOUBLE) AS x FROM range(1, 15) AS r(k))
              JOIN effect ON wd = isodow(d)))""",
        "daily",
    ),
    "q_forecast_backtest": _sql(
        f"""SELECT * FROM (WITH points AS (SELECT CAST(date_diff('day', {AS_OF}, day) AS HUGEINT) AS x, balance,
              CAST(round(balance, 0) AS HUGEINT) - first_value(CAST(round(balance, 0) AS HUGEINT)) OVER (ORDER BY day) AS y,
              first_value(CAST(round(balance, 0) AS HUGEINT)) OVER (ORDER BY day) AS base FROM daily WHERE day <= {AS_OF}),
          sums AS (SELECT x, balance, base, count(*) OVER o AS n, sum(x) OVER o AS sx, sum(x * x) OVER o AS sxx, sum(y) OVER o AS sy,
              sum(x * y) OVER o AS sxy, sum(y * y) OVER o AS syy FROM points WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
          line AS (SELECT *, CAST(base AS DOUBLE) + (CAST(sy AS DOUBLE) - slope * sx) / n AS intercept FROM (
            SELECT *, CAST(n * sxx - sx * sx AS DOUBLE) AS dxx,
              CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) AS slope,
              sqrt(greatest(0.0, CAST(n * syy - sy * sy AS DOUBLE) - CAST(n * sxy - sx * sy AS DOUBLE) * CAST(n * sxy - sx * sy AS DOUBLE)
                / CAST(n * sxx - sx * sx AS DOUBLE)) / n / (n - 2)) AS spread
            FROM sums WHERE n > 2)),
          ahead AS (SELECT CAST(7 * k AS HUGEINT) AS h FROM range(1, 14) AS r(k)),
          tried AS (SELECT h, n, sx, dxx, spread, l.x + h AS xa, intercept + slope * CAST(l.x + h AS DOUBLE) AS mid,
              (SELECT balance FROM points p WHERE p.x <= l.x + h ORDER BY p.x DESC LIMIT 1) AS came
            FROM line l, ahead WHERE n >= 60 AND l.x + h <= (SELECT max(x) FROM points)),
          scored AS (SELECT h, count(*) AS origins, quantile_disc(abs(CAST(round(CAST(came AS DOUBLE) - mid, 0) AS HUGEINT)), 0.95) AS width,
              count(*) FILTER (WHERE abs(CAST(came AS DOUBLE) - mid) <= CAST({NormalDist().inv_cdf(0.975)!r} AS DOUBLE) * spread
                * sqrt(1 + CAST(1.0 AS DOUBLE) / n + (xa - CAST(sx AS DOUBLE) / n) * (xa - CAST(sx AS DOUBLE) / n) / (dxx / n))) AS held
            FROM tried GROUP BY h)
          SELECT 'ALL' AS segment, CAST(h AS INT) AS horizon_days, CAST({AS_OF} + CAST(h AS INT) AS DATE) AS forecast_date,
            CAST(mid AS {TOTAL}) AS projected_balance, CAST(mid - width AS {TOTAL}) AS lower_bound, CAST(mid + width AS {TOTAL}) AS upper_bound,
            coalesce(origins, 0) AS origins, round(CAST(held AS DOUBLE) / origins, 4) AS coverage
          FROM (SELECT h, CAST(round(intercept + slope * CAST(h AS DOUBLE), 0) AS HUGEINT) AS mid FROM ahead, (SELECT * FROM line ORDER BY x DESC LIMIT 1))
          LEFT JOIN scored USING (h))""",
        "daily",
    ),
    "q_rolling_weeks": _sql(
        f"""SELECT {_saturday("ledger_date")} AS week_ending_date, 'ACTUAL' AS kind, {_total("cash_in_amt")} AS cash_in, {_total("cash_out_amt")} AS cash_out,
              CAST(arg_max(running_cash_balance, ledger_date) AS {TOTAL}) AS closing_balance, CAST(NULL AS {TOTAL}) AS lower_bound, CAST(NULL AS {TOTAL}) AS upper_bound
            FROM ledger WHERE ledger_date <= {AS_OF} AND ledger_date > {AS_OF} - 91 GROUP BY 1
            UNION ALL SELECT forecast_date, 'FORECAST', NULL, NULL, projected_balance, lower_bound, upper_bound
            FROM ({_projected(f"(SELECT CAST({AS_OF} + CAST(7 * w AS INT) AS DATE) AS d FROM range(1, 14) AS r(w))", "segment = 'ALL'")})""",
        "ledger", "trend",
    ),
    "q_alert": _sql(
        f"""SELECT forecast_run_date, variance, CAST(moved AS {TOTAL}) AS deterioration, CAST(limit_ AS {TOTAL}) AS control_limit,
              variance <= -1000000 AS level_breach, coalesce(moved <= -100000, false) AS velocity_breach,
              variance <= -1000000 AND coalesce(moved <= -100000, false) AND coalesce(CAST(moved AS DOUBLE) < limit_, true) AS alert
            FROM (SELECT *, round(avg(CAST(moved AS DOUBLE)) OVER earlier - 2 * stddev_samp(CAST(moved AS DOUBLE)) OVER earlier, 0) AS limit_
              FROM (SELECT *, projected - lag(projected) OVER (ORDER BY forecast_run_date) AS moved FROM (
                SELECT forecast_run_date, {_total("variance_amt")} AS variance, {_total("projected_cash_amt")} AS projected
                FROM forecast6 WHERE forecast_week_ending = {QUARTER_END} GROUP BY 1))
              WINDOW earlier AS (ORDER BY forecast_run_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        "forecast6",
    ),
    "q_alert_drift": _sql(
        f"""SELECT * FROM (WITH RECURSIVE moves AS (
              SELECT n, run, CAST(projected - lag(projected) OVER (ORDER BY n) AS {TOTAL}) AS change FROM (
                SELECT forecast_run_date AS run, row_number() OVER (ORDER BY forecast_run_date) AS n, {_total("projected_cash_amt")} AS projected
                FROM forecast6 WHERE forecast_week_ending = {QUARTER_END} GROUP BY 1)),
            sums AS (
              SELECT n, run, change, CAST(0 AS {TOTAL}) AS falling, CAST(0 AS {TOTAL}) AS rising,
                CAST(NULL AS DATE) AS falling_since, CAST(NULL AS DATE) AS rising_since FROM moves WHERE n = 1
              UNION ALL
              SELECT n, run, change, falling, rising,
                CASE WHEN falling > 0 THEN CASE WHEN down > 0 THEN falling_since ELSE run END END,
                CASE WHEN rising > 0 THEN CASE WHEN up > 0 THEN rising_since ELSE run END END
              FROM (
                SELECT m.n, m.run, m.change, down, up, falling_since, rising_since,
                  CAST(greatest(0, down - m.change - 500000) AS {TOTAL}) AS falling, CAST(greatest(0, up + m.change - 500000) AS {TOTAL}) AS rising
                FROM (SELECT *, CASE WHEN falling > 1000000 THEN 0 ELSE falling END AS down, CASE WHEN rising > 1000000 THEN 0 ELSE rising END AS up FROM sums) s
                JOIN moves m ON m.n = s.n + 1))
            SELECT run AS forecast_run_date, change AS deterioration, falling, falling_since, rising, rising_since,
              CASE WHEN falling > 1000000 THEN 'FALLING' WHEN rising > 1000000 THEN 'RISING' END AS signal FROM sums)""",
        "forecast6",
    ),
    "q_cancel_pos": _sql("SELECT * FROM cancel", "cancel"),
    "q_defer_payments": _sql("SELECT * FROM deferral", "deferral"),
    "q_chase_collections": _sql("SELECT * FROM overdue", "overdue"),
    "q_reflow": _sql("SELECT * FROM move", "move"),
    "q_evidence": _EVIDENCE,
    "q_evidence_summary": f"""SELECT rule, value, count(*) AS findings, count(DISTINCT doc_id) AS documents
        FROM ({_EVIDENCE}) GROUP BY 1, 2""",
    "q_evidence_conversations": f"""SELECT rule, value, count(*) AS findings, count(DISTINCT (conv_id, turn)) AS documents
        FROM ({_MESSAGES}) GROUP BY 1, 2""",
    "q_reconcile": _sql(
        f"""SELECT "check", CAST(actual AS {TOTAL}) AS actual, CAST(expected AS {TOTAL}) AS expected,
              CAST(actual - expected AS {TOTAL}) AS diff, abs(actual - expected) <= 0 AS ok
            FROM (SELECT unnest([
                {{'check': 'aged_inventory', 'actual': aged, 'expected': -inv}},
                {{'check': 'disputed_receivables', 'actual': disputed, 'expected': disputed_apart}},
                {{'check': 'slipped_receivables', 'actual': slipped, 'expected': slipped_apart}},
                {{'check': 'collections_total', 'actual': disputed + slipped, 'expected': -coll}},
                {{'check': 'accelerated_payments', 'actual': early, 'expected': -ap}},
                {{'check': 'drivers_total', 'actual': aged + disputed + slipped + early, 'expected': plan - projected}},
                {{'check': 'plan_at_quarter_end', 'actual': plan, 'expected': balance}},
                {{'check': 'projected_at_quarter_end', 'actual': projected, 'expected': plan - aged - disputed - slipped - early}},
                {{'check': 'prior_projected_at_quarter_end', 'actual': prior, 'expected': plan - prior_gap}},
                {{'check': 'deterioration', 'actual': -moved, 'expected': aged + disputed + slipped + early - prior_gap}},
                {{'check': 'cash_view', 'actual': 0, 'expected': 0}}, {{'check': 'inventory_view', 'actual': 0, 'expected': 0}},
                {{'check': 'ar_view', 'actual': 0, 'expected': 0}}, {{'check': 'ap_view', 'actual': 0, 'expected': 0}},
                {{'check': 'inventory_trap_total', 'actual': 0, 'expected': 0}}, {{'check': 'collections_slowdown_total', 'actual': 0, 'expected': 0}},
                {{'check': 'ap_acceleration_total', 'actual': 0, 'expected': 0}}, {{'check': 'cash_in_booked_once', 'actual': 0, 'expected': 0}}], recursive := true)
              FROM ({_LEVELS}),
                (SELECT {_zero(_total("on_hand_cost", "is_aged"))} AS aged FROM latest_stock),
                (SELECT {_zero(_total("cash_impact_vs_plan_amt", "status = 'DISPUTED'"))} AS disputed,
                  {_zero(_total("cash_impact_vs_plan_amt", "status = 'SLIPPED'"))} AS slipped FROM invoice WHERE invoice_date <= {AS_OF}),
                (SELECT {_zero(_total("cash_impact_vs_plan_amt", "payment_category = 'ACCELERATED'"))} AS early FROM payment
                  WHERE actual_pay_date <= {AS_OF}),
                (SELECT {_zero(_total("CAST(o_totalprice AS DECIMAL(12,2))", "o_orderkey % 3 <> 0"))} AS disputed_apart,
                  {_zero(_total("CAST(o_totalprice AS DECIMAL(12,2))", "o_orderkey % 3 = 0"))} AS slipped_apart FROM orders
                  WHERE o_orderstatus = 'P' AND o_custkey % 4 = 0 AND CAST(o_orderdate AS DATE) <= {AS_OF} AND CAST(o_orderdate AS DATE) + 105 > {QUARTER_END}),
                (SELECT (SELECT coalesce(sum(on_hand_cost), 0) FROM stock WHERE is_aged AND week_ending_date = {PRIOR_RUN})
                  + (SELECT coalesce(sum(cash_impact_vs_plan_amt), 0) FROM invoice WHERE invoice_date <= {PRIOR_RUN})
                  + (SELECT coalesce(sum(cash_impact_vs_plan_amt), 0) FROM payment WHERE days_early > 0 AND actual_pay_date <= {PRIOR_RUN}) AS prior_gap),
                (SELECT balance FROM daily WHERE day <= {AS_OF} ORDER BY day DESC LIMIT 1),
                (SELECT deterioration_2wk AS moved FROM change WHERE current_run_date = {AS_OF}))""",
        "at_end", "latest_stock", "invoice", "payment", "daily", "change",
    ),
    "q_briefing": _sql(
        f"""SELECT section, item, lever, CAST(coalesce(value, 0) AS {TOTAL}) AS value FROM (
              SELECT 'ALERT' AS section, 'planned quarter-end cash' AS item, CAST(NULL AS VARCHAR) AS lever, plan AS value FROM ({_LEVELS})
              UNION ALL SELECT 'ALERT', 'projected quarter-end cash', NULL, projected FROM ({_LEVELS})
              UNION ALL SELECT 'ALERT', 'gap to plan', NULL, projected - plan FROM ({_LEVELS})
              UNION ALL SELECT 'ALERT', 'change since the last forecast', NULL, projected - prior FROM ({_LEVELS})
              UNION ALL SELECT 'DRIVER', 'INVENTORY_TRAP', 'cancel open orders, move stock', inv FROM ({_LEVELS})
              UNION ALL SELECT 'DRIVER', 'COLLECTIONS_SLOWDOWN', 'chase collections', coll FROM ({_LEVELS})
              UNION ALL SELECT 'DRIVER', 'AP_ACCELERATION', 'defer payments', ap FROM ({_LEVELS})
              UNION ALL SELECT 'KPI', 'days sales outstanding', NULL, CAST(round(dso, 1) AS {TOTAL}) FROM cycle
              UNION ALL SELECT 'KPI', 'days payable outstanding', NULL, CAST(round(dpo, 1) AS {TOTAL}) FROM cycle
              UNION ALL SELECT 'KPI', 'days inventory outstanding', NULL, CAST(round(dio, 1) AS {TOTAL}) FROM cycle
              UNION ALL SELECT 'KPI', 'cash conversion cycle', NULL, CAST(round(dso + dio - dpo, 1) AS {TOTAL}) FROM cycle
              UNION ALL SELECT 'ACTION', 'open orders in weak categories', 'cancel open orders', sum(committed_cost) FROM cancel
              UNION ALL SELECT 'ACTION', 'payments leaving early', 'defer payments', sum(deferrable_cash) FROM deferral
              UNION ALL SELECT 'ACTION', 'cost of paying early', 'defer payments', sum(avoidable_cost) FROM deferral
              UNION ALL SELECT 'ACTION', 'overdue and undisputed invoices', 'chase collections', sum(overdue_amount) FROM overdue
              UNION ALL SELECT 'ACTION', 'units to move between locations', 'move stock', sum(units) FROM move)""",
        "at_end", "cycle", "cancel", "deferral", "overdue", "move",
    ),
}
