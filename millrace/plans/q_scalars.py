"""Registered 2H scalar-helper projections and their oracles (one query per helper id).

Each helper is checked by projecting it over a bound table, so it runs on
every row of that table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as H
from millrace.plans.catalog import AS_OF, AS_OF_EVENTS, register

_UP, _LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RT = "rtrim(rtrim({}, '0'), '.')".format
MS = "CAST(SUM(CAST({} AS DECIMAL(18,4))) AS DOUBLE)".format


def _case_map(domain: str, col: str, fallback: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in H.LABELS[domain].items())
    return f"CASE {col} {whens} ELSE {fallback or col} END"


def _asof_ts():
    return F.to_timestamp_ntz(F.lit(f"{AS_OF} 00:00:00"))


@register("h1_aggregates", f"""
SELECT category, COALESCE({MS('amount')}, 0) AS total, COUNT(*) AS n, max(amount) AS max_amount,
       {MS('amount')} / COUNT(amount) AS avg_amount
FROM expenses GROUP BY category
""")
def h1(t):
    return t.expenses.groupBy("category").agg(H.msum0("amount").alias("total"), F.count(F.lit(1)).alias("n"),
                                              F.max("amount").alias("max_amount"), H.mavg("amount").alias("avg_amount"))


@register("h2_year_month", "SELECT id, strftime(order_date, '%Y-%m') AS ym FROM sales_orders")
def h2(t):
    return t.sales_orders.select("id", H.year_month("order_date").alias("ym"))


@register("h3_date_arithmetic", f"""
SELECT id, CAST(created_at AS DATE) AS created_day, CAST(order_date + INTERVAL 7 DAY AS DATE) AS week_later,
       CAST(DATE '{AS_OF}' - INTERVAL 6 DAY AS DATE) AS window_start, order_date < DATE '{AS_OF}' AS before_as_of
FROM sales_orders
""")
def h3(t):
    return t.sales_orders.select("id", F.to_date("created_at").alias("created_day"),
                                 F.date_add("order_date", 7).alias("week_later"),
                                 F.date_sub(F.to_date(F.lit(AS_OF)), 6).alias("window_start"),
                                 (F.col("order_date") < F.to_date(F.lit(AS_OF))).alias("before_as_of"))


@register("h4_julian_days", f"""
SELECT id, (epoch_us(TIMESTAMP '{AS_OF} 00:00:00') - epoch_us(CAST(due_date AS TIMESTAMP))) / 86400000000.0 AS days_overdue
FROM sales_orders
""")
def h4(t):
    return t.sales_orders.select("id", H.julian_days_between(_asof_ts(), F.col("due_date").cast("timestamp_ntz"))
                                 .alias("days_overdue"))


@register("h5_predicates", """
SELECT id, CASE WHEN status IN ('pending', 'confirmed') THEN 'open' WHEN status = 'cancelled' THEN 'void' ELSE 'closed' END
         AS grp,
       status NOT IN ('paid', 'cancelled') AS owing, total_amount BETWEEN 1000 AND 100000 AS mid_size,
       due_date IS NULL AS no_due_date
FROM sales_orders
""")
def h5(t):
    s = F.col("status")
    return t.sales_orders.select(
        "id", F.when(s.isin("pending", "confirmed"), "open").when(s == "cancelled", "void").otherwise("closed").alias("grp"),
        (~s.isin("paid", "cancelled")).alias("owing"), F.col("total_amount").between(1000, 100000).alias("mid_size"),
        F.col("due_date").isNull().alias("no_due_date"))


@register("h6_like_search", f"""
SELECT id, code, name FROM customers
WHERE translate(name, '{_UP}', '{_LO}') LIKE '%mer#0000001_%' OR translate(code, '{_UP}', '{_LO}') LIKE '%c00000%5%'
""")
def h6(t):
    c = t.customers
    return c.where(H.sqlite_like_contains("name", "MER#0000001_") | H.sqlite_like_contains("code", "c00000%5")) \
        .select("id", "code", "name")


@register("h7_sqlite_max0", """
SELECT id, CASE WHEN quantity IS NULL THEN NULL ELSE greatest(0.0, quantity - 250) END AS floored FROM material_logs
""")
def h7(t):
    return t.material_logs.select("id", H.sqlite_max0(F.col("quantity") - 250).alias("floored"))


@register("h8_order_amounts", """
SELECT so.id, so.total_amount - so.paid_amount AS outstanding, greatest(0.0, so.total_amount - so.paid_amount)
         AS suggested_payment, i.line_sum
FROM sales_orders so LEFT JOIN (SELECT order_id, CAST(SUM(CAST(quantity * unit_price AS DECIMAL(18,4))) AS DOUBLE)
                                  AS line_sum FROM sales_items GROUP BY order_id) i ON i.order_id = so.id
""")
def h8(t):
    lines = t.sales_items.groupBy("order_id").agg(H.msum(H.line_total("quantity", "unit_price")).alias("line_sum"))
    return t.sales_orders.join(lines.withColumnRenamed("order_id", "id"), "id", "left").select(
        "id", H.outstanding("total_amount", "paid_amount").alias("outstanding"),
        H.suggested_payment("total_amount", "paid_amount").alias("suggested_payment"), "line_sum")


@register("h9_profit_margin", """
SELECT id, price - cost AS unit_profit, CASE WHEN price > 0 THEN (price - cost) / price * 100 ELSE 0.0 END AS margin_pct
FROM products
""")
def h9(t):
    return t.products.select("id", H.unit_profit("price", "cost").alias("unit_profit"),
                             H.margin_pct(H.unit_profit("price", "cost"), F.col("price")).alias("margin_pct"))


@register("h10_stock_status", """
SELECT id, CASE WHEN stock = 0 THEN 'empty' WHEN stock <= min_stock AND stock > 0 THEN 'low' ELSE 'ok' END AS status
FROM products
UNION ALL
SELECT 100000000 + id, CASE WHEN quantity = 0 THEN 'empty' WHEN quantity <= min_quantity AND quantity > 0 THEN 'low'
                            ELSE 'ok' END FROM raw_materials
""")
def h10(t):
    return t.products.select("id", H.stock_status("stock", "min_stock").alias("status")).unionByName(
        t.raw_materials.select((F.col("id") + 100000000).alias("id"),
                               H.stock_status("quantity", "min_quantity").alias("status")))


@register("h11_stock_pct", """
SELECT id, CAST(least(100, floor(stock / greatest(min_stock * 2, 1) * 100 + 0.5)) AS BIGINT) AS pct FROM products
""")
def h11(t):
    return t.products.select("id", H.stock_pct("stock", "min_stock").alias("pct"))


@register("h12_size_label", f"""
SELECT id,
  CASE WHEN size_ml IS NULL OR size_ml = 0 THEN '-'
       WHEN size_ml >= 1000 THEN {_RT('CAST(CAST(size_ml / 1000 AS DECIMAL(20,6)) AS VARCHAR)')} || 'L'
       ELSE CAST(size_ml AS VARCHAR) || 'ml' END AS size_label,
  CASE WHEN size_ml >= 19000 THEN 'bucket' WHEN size_ml >= 5000 THEN 'gallon' WHEN size_ml >= 1500 THEN 'large'
       WHEN size_ml >= 600 THEN 'medium' ELSE 'small' END AS size_band
FROM products
""")
def h12(t):
    return t.products.select("id", H.size_label("size_ml").alias("size_label"), H.size_band("size_ml").alias("size_band"))


_KIND = " ".join(
    f"WHEN {' OR '.join(f'contains(lower(COALESCE(name, {chr(39)}{chr(39)})), {chr(39)}{w}{chr(39)})' for w in words)} "
    f"THEN '{kind}'" for kind, words in H.MATERIAL_KEYWORDS)


@register("h13_material_kind", f"SELECT id, CASE {_KIND} ELSE 'box' END AS kind FROM raw_materials")
def h13(t):
    return t.raw_materials.select("id", H.material_kind("name").alias("kind"))


@register("h14_labels", f"""
SELECT 'customer_type' AS domain, CAST(id AS VARCHAR) AS k, {_case_map('customer_type', 'type')} AS label FROM customers
UNION ALL SELECT 'status', CAST(id AS VARCHAR), {_case_map('status', 'status')} FROM sales_orders
UNION ALL SELECT 'role', CAST(id AS VARCHAR), {_case_map('role', 'role')} FROM users
UNION ALL SELECT 'po_status', CAST(id AS VARCHAR), {_case_map('po_status', 'status')} FROM purchase_orders
UNION ALL SELECT 'expense_category', CAST(id AS VARCHAR), {_case_map('expense_category', 'category')} FROM expenses
UNION ALL SELECT 'return_reason', CAST(id AS VARCHAR), {_case_map('return_reason', 'reason')} FROM returns
UNION ALL SELECT 'return_status', CAST(id AS VARCHAR), {_case_map('return_status', 'status')} FROM returns
UNION ALL SELECT 'route_status', CAST(id AS VARCHAR), {_case_map('route_status', 'status')} FROM delivery_routes
UNION ALL SELECT 'payment_method', CAST(id AS VARCHAR),
                 {_case_map('payment_method', 'method', "'" + H.PAYMENT_METHOD_FALLBACK + "'")} FROM payments
UNION ALL SELECT 'material_move', CAST(id AS VARCHAR),
                 {_case_map('material_move', 'type', "'" + H.MATERIAL_MOVE_FALLBACK + "'")} FROM material_logs
""")
def h14(t):
    def part(df, domain, col):
        return df.select(F.lit(domain).alias("domain"), F.col("id").cast("string").alias("k"),
                         H.label(domain, col).alias("label"))
    return (part(t.customers, "customer_type", "type").unionByName(part(t.sales_orders, "status", "status"))
            .unionByName(part(t.users, "role", "role"))
            .unionByName(part(t.purchase_orders, "po_status", "status"))
            .unionByName(part(t.expenses, "expense_category", "category"))
            .unionByName(part(t.returns, "return_reason", "reason"))
            .unionByName(part(t.returns, "return_status", "status"))
            .unionByName(part(t.delivery_routes, "route_status", "status"))
            .unionByName(part(t.payments, "payment_method", "method"))
            .unionByName(part(t.material_logs, "material_move", "type")))


_DIFF = f"floor((epoch_us(TIMESTAMP '{AS_OF_EVENTS} 12:00:00') - epoch_us(created_at)) / 1000000.0)"


@register("h15_time_ago", f"""
SELECT id, CASE WHEN created_at IS NULL THEN ''
  WHEN {_DIFF} < 60 THEN 'เมื่อกี้'
  WHEN {_DIFF} < 3600 THEN CAST(CAST(floor({_DIFF} / 60) AS BIGINT) AS VARCHAR) || ' นาทีที่แล้ว'
  WHEN {_DIFF} < 86400 THEN CAST(CAST(floor({_DIFF} / 3600) AS BIGINT) AS VARCHAR) || ' ชม.ที่แล้ว'
  ELSE CAST(CAST(floor({_DIFF} / 86400) AS BIGINT) AS VARCHAR) || ' วันที่แล้ว' END AS ago
FROM production_orders
""")
def h15(t):
    return t.production_orders.select(
        "id", H.time_ago("created_at", F.to_timestamp_ntz(F.lit(f"{AS_OF_EVENTS} 12:00:00"))).alias("ago"))


_STRIP = "name"
for _p in H.BRAND_PREFIXES:
    _STRIP = (f"CASE WHEN strpos({_STRIP}, '{_p}') > 0 THEN substr({_STRIP}, 1, strpos({_STRIP}, '{_p}') - 1) || "
              f"substr({_STRIP}, strpos({_STRIP}, '{_p}') + {len(_p)}) ELSE {_STRIP} END")


@register("h16_strip_prefix", f"SELECT id, {_STRIP} AS chart_name FROM products")
def h16(t):
    return t.products.select("id", H.strip_first("name", H.BRAND_PREFIXES).alias("chart_name"))


_THAI_MONTHS = "[" + ", ".join(f"'{m}'" for m in H.THAI_MONTHS) + "]"


@register("h17_formats", f"""
SELECT p.id, '฿' || format('{{:,.2f}}', p.price) AS price_text, {_RT("format('{:,.3f}', p.price)")} AS price_number,
  CASE WHEN so.order_date IS NULL THEN '-' ELSE CAST(day(so.order_date) AS VARCHAR) || ' '
       || {_THAI_MONTHS}[month(so.order_date)] || ' ' || CAST(year(so.order_date) + 543 AS VARCHAR) END AS date_text
FROM products p LEFT JOIN sales_orders so ON so.id = p.id
""")
def h17(t):
    so = t.sales_orders.select("id", "order_date")
    return t.products.select("id", "price").join(so, "id", "left").select(
        "id", H.fmt_currency("price").alias("price_text"), H.fmt_number("price").alias("price_number"),
        H.fmt_date("order_date").alias("date_text"))


@register("h18_text_helpers", """
SELECT id, trim('  ' || name || ' ') AS trimmed, lower(name) AS lowered, upper(code) AS upper_code,
       starts_with(code, 'C00000') AS code_prefix, contains(lower(name), '#0000001') AS has_text,
       substr(CAST(CAST(id AS VARCHAR) || '-2024-01-05' AS VARCHAR), 1, 7) AS first7,
       printf('C%05d', id) AS padded
FROM customers
""")
def h18(t):
    c = t.customers
    return c.select("id", F.trim(F.concat(F.lit("  "), F.col("name"), F.lit(" "))).alias("trimmed"),
                    F.lower("name").alias("lowered"), F.upper("code").alias("upper_code"),
                    F.col("code").startswith("C00000").alias("code_prefix"),
                    F.lower("name").contains("#0000001").alias("has_text"),
                    F.substring(F.concat(F.col("id").cast("string"), F.lit("-2024-01-05")), 1, 7).alias("first7"),
                    H.doc_number("C", F.col("id")).alias("padded"))


@register("h19_message_templates", """
SELECT id, '"' || name || '" เหลือ ' || CAST(stock AS VARCHAR) || ' (ขั้นต่ำ ' || CAST(min_stock AS VARCHAR) || ')' AS msg
FROM products
""")
def h19(t):
    return t.products.select("id", H.low_stock_message("name", "stock", "min_stock").alias("msg"))
