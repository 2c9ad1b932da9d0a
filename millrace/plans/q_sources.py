"""Registered 2A source / sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalars as H
from millrace.operators import envelopes as V
from millrace.operators import reports as R
from millrace.plans.catalog import AS_OF, EV_FROM, EV_TO, FROM, PLAIN, TO, register
from millrace.plans.q_reports import D6_SQL, PROFIT_SQL

PROFIT_ROWS = PROFIT_SQL
from millrace.sources import io as A
from millrace.sources.tables import load_table

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("code", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("phone", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("credit_limit", T.DoubleType()), T.StructField("balance", T.DoubleType()),
    T.StructField("active", T.IntegerType()),
])


@register("a1_load_table", "SELECT * FROM orders")
def a1(t):
    return load_table(t.spark, t.sf_dir, "orders")


@register("a2_normalize_input", """
SELECT id, code, name, phone, type, credit_limit, balance, active FROM customers
""")
def a2(t):
    # form-style input: everything text, padded, empty phone as '' (what the UI sends)
    c = t.customers
    raw = c.select(*[F.concat(F.lit(" "), F.coalesce(F.col(x).cast("string"), F.lit("")), F.lit(" ")).alias(x)
                     for x in c.columns])
    return A.normalize_input(raw, CUSTOMER_SCHEMA, defaults={"type": "retail"})


@register("a3_evolve_schema", """
SELECT *, CAST(NULL AS VARCHAR) AS batch_number, CAST(NULL AS DATE) AS expiry_date FROM production_orders
""")
def a3(t):
    target = T.StructType([T.StructField("batch_number", T.StringType()), T.StructField("expiry_date", T.DateType())])
    return A.evolve_schema(t.production_orders, target)


SALES_LINES = f"""
WITH d AS ({{D6}})
SELECT 0 AS _h, NULL::DOUBLE AS _o0, NULL::BIGINT AS _o1,
       chr(65279) || '"' || '{'","'.join(A.SALES_CSV_HEADERS)}' || '"' AS line
UNION ALL
SELECT 1, revenue, product_id, '"' || replace(name, '"', '""') || '","' || {{NUM}} || '","'
       || '฿' || format('{{:,.2f}}', revenue) || '"' FROM d
"""


@register("a4_export_sales_csv_lines", SALES_LINES.replace("{D6}", D6_SQL).replace(
    "{NUM}", "rtrim(rtrim(format('{:,.3f}', CAST(quantity AS DOUBLE)), '0'), '.')"))
def a4(t):
    d = R.sales_by_product(t.sales_orders, t.sales_items, t.products, FROM, TO)
    cells = [F.col("name"), H.fmt_number("quantity"), H.fmt_currency("revenue")]
    return A.csv_lines(d, cells, A.SALES_CSV_HEADERS, [("revenue", False), ("product_id", True)])


_FMT2 = "'฿' || format('{{:,.2f}}', {})".format


@register("a4_export_profit_csv_lines", f"""
WITH d AS ({PROFIT_ROWS})
SELECT 0 AS _h, NULL::DOUBLE AS _o0, NULL::BIGINT AS _o1,
       chr(65279) || '"' || '{'","'.join(A.PROFIT_CSV_HEADERS)}' || '"' AS line
UNION ALL
SELECT 1, profit, product_id, '"' || replace(name, '"', '""') || '","'
       || rtrim(rtrim(format('{{:,.3f}}', CAST(qty AS DOUBLE)), '0'), '.') || '","' || {_FMT2('revenue')} || '","'
       || {_FMT2('cost')} || '","' || {_FMT2('profit')} || '","'
       || CASE WHEN revenue > 0 THEN printf('%.1f', profit / revenue * 100) ELSE '0' END || '%"' FROM d
""")
def a4_profit(t):
    d = R.profit_by_product(t.sales_orders, t.sales_items, t.products, FROM, TO)
    margin = F.when(F.col("revenue") > 0, F.format_string("%.1f", F.col("profit") / F.col("revenue") * 100)) \
        .otherwise(F.lit("0"))
    cells = [F.col("name"), H.fmt_number("qty"), H.fmt_currency("revenue"), H.fmt_currency("cost"),
             H.fmt_currency("profit"), F.concat(margin, F.lit("%"))]
    return A.csv_lines(d, cells, A.PROFIT_CSV_HEADERS, [("profit", False), ("product_id", True)])


def _fields_sql(*parts: tuple[str, str, str]) -> str:
    """(part, SQL of its rows, key column or '') -> every field of every row as number or text."""
    rows = " UNION ALL ".join(f"SELECT '{part}' AS part, {f'CAST(x.{key} AS VARCHAR)' if key else repr('')} AS row_key, to_json(x) AS j "
                              f"FROM ({sql}) x" for part, sql, key in parts)
    return f"""
WITH docs AS ({rows}),
cells AS (SELECT part, row_key, f.field, json_extract_string(j, f.field) AS v FROM docs, LATERAL (SELECT unnest(json_keys(j)) AS field) f)
SELECT part, row_key, field, TRY_CAST(v AS DOUBLE) AS num, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v END AS txt FROM cells
"""


def _fields(t, report: str, keys: dict[str, str], date_from: str, date_to: str):
    """The report's lines, read back: every field of every row as number or text."""
    parts, meta = V.report(t, report, date_from, date_to, f"{AS_OF} 00:00:00")
    rows = A.report_json_lines(parts, meta).where("part IS NOT NULL").select(
        "part", F.when(F.col("json").startswith("{"), F.from_json("json", "map<string,string>")).otherwise(
            F.create_map(F.lit("value"), F.col("json"))).alias("m"))
    key = F.lit("")
    for part, col in keys.items():
        key = F.when(F.col("part") == part, F.col("m")[col]).otherwise(key)
    rows = rows.select("part", key.alias("row_key"), F.explode("m").alias("field", "v"))
    num = F.expr("try_cast(v AS DOUBLE)")
    return rows.select("part", "row_key", "field", num.alias("num"), F.when(num.isNull(), F.col("v")).alias("txt"))


def _plain(name: str) -> str:
    """A registered query's SQL before the tables' definitions were put in front."""
    return PLAIN[name]


@register("a5_report_json", _fields_sql(
    ("summary", _plain("d4_sales_summary"), ""), ("byDay", _plain("d5_sales_by_day"), "date"),
    ("byProduct", _plain("d6_sales_by_product"), "product_id"), ("byCustomer", _plain("d7_sales_by_customer"), "customer_id")))
def a5(t):
    return _fields(t, "sales", {"byDay": "date", "byProduct": "product_id", "byCustomer": "customer_id"}, FROM, TO)


@register("a5_profit_report_json", _fields_sql(
    ("byProduct", _plain("d10_profit_by_product"), "product_id"),
    ("total", f"SELECT revenue, cost, profit FROM ({_plain('d11_profit_total')})", "")))
def a5_profit(t):
    return _fields(t, "profit", {"byProduct": "product_id"}, FROM, TO)


@register("a5_credit_report_json", _fields_sql(
    ("customers", _plain("d15_receivables_by_customer"), "customer_id"), ("aging", _plain("d16_receivables_aging"), "customer_id")))
def a5_credit(t):
    return _fields(t, "credit", {"customers": "customer_id", "aging": "customer_id"}, FROM, TO)


@register("a5_expenses_report_json", _fields_sql(
    ("byCategory", f"SELECT category, total, count FROM ({_plain('d12_expenses_by_category')}) WHERE NOT is_total", "category"),
    ("total", f"SELECT total AS value FROM ({_plain('d12_expenses_by_category')}) WHERE is_total", ""),
    ("byMonth", _plain("d13_expenses_by_month"), "month")))
def a5_expenses(t):
    return _fields(t, "expenses", {"byCategory": "category", "byMonth": "month"}, EV_FROM, EV_TO)
