"""2F: the activity feed and the notification list (unions of small top-k frames).

Each source is cut to its own top-k first (TakeOrderedAndProject: a per-task
top-k, then a k-row merge), so the union only ever sees a few dozen rows.
Ties keep the reference's stable order through an explicit ``source_rank``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import label
from millrace.operators.filters import low_stock, maintenance_due, overdue_orders
from millrace.operators.reports import deposit_alerts
from millrace.operators.rules import js_number


def activity_feed(o: DataFrame, c: DataFrame, ml: DataFrame, m: DataFrame, po: DataFrame, p: DataFrame,
                  k: int = 12) -> DataFrame:
    """newest 5 sales, 4 material moves and 4 production orders in one
    6-column shape, newest first, first ``k``; ties keep source order."""
    def newest(rows: DataFrame, names: DataFrame, key: str, name: str, n: int) -> DataFrame:
        """The newest ``n`` rows that have a parent; only they fetch its name."""
        top = rows.join(names.select(F.col("id").alias(key)), key, "left_semi").orderBy(F.desc("created_at"), F.desc("id")).limit(n)
        return top.join(names.select(F.col("id").alias(key), F.col("name").alias(name)), key)

    sales = (newest(o, c, "customer_id", "_cn", 5)
             .select(F.lit("sale").alias("type"), F.col("order_number").alias("ref"), F.col("_cn").alias("detail"),
                     F.col("total_amount").cast("double").alias("amount"), "status", "created_at",
                     F.lit(0).alias("source_rank"), "id"))
    logs = (newest(ml, m, "material_id", "_mn", 4)
            .select(F.lit("material").alias("type"), F.col("_mn").alias("ref"),
                    label("material_move", "type").alias("detail"), F.col("quantity").cast("double").alias("amount"),
                    F.lit(None).cast("string").alias("status"), "created_at", F.lit(1).alias("source_rank"), "id"))
    prod = (newest(po, p, "product_id", "_pn", 4)
            .select(F.lit("production").alias("type"), F.col("_pn").alias("ref"), F.col("status").alias("detail"),
                    F.col("quantity_planned").cast("double").alias("amount"), "status", "created_at",
                    F.lit(2).alias("source_rank"), "id"))
    return (sales.unionByName(logs).unionByName(prod)
            .orderBy(F.desc("created_at"), "source_rank", F.desc("id")).limit(k))


# Notification icons and message templates (Thai), per source.
NOTIFY = {
    "product_out": 'สินค้า "%s" หมดสต็อก',
    "product_low": 'สินค้า "%s" สต็อกต่ำ (%s/%s)',
    "material_out": 'วัตถุดิบ "%s" หมด',
    "material_low": 'วัตถุดิบ "%s" ใกล้หมด (%s/%s)',
    "overdue": "ใบ %s (%s) เกินกำหนดชำระ",
    "production": "ใบสั่งผลิตรอดำเนินการ %s รายการ",
    "maintenance": 'เครื่อง "%s" ถึงกำหนดซ่อมบำรุง',
    "deposit": "%s ค้างถัง %s ใบ",
}
ICONS = {"product": "droplet-half", "material": "boxes", "overdue": "exclamation-circle-fill",
         "production": "gear-wide-connected", "maintenance": "wrench-adjustable", "deposit": "archive"}


def notifications(p: DataFrame, m: DataFrame, o: DataFrame, c: DataFrame, po: DataFrame, e: DataFrame,
                  cd: DataFrame, as_of, as_of_events=None) -> DataFrame:
    """the six alert sources concatenated in the reference's fixed order.

    Columns: source_rank, sort_value, sort_id (order inside a source), type,
    icon, msg, category. ``danger`` only for exactly 0 stock (negative stock is a
    warning) and for overdue orders. The count is ``notifications(...).count()``.
    """
    ev_day = as_of_events or as_of

    def shape(df, rank, typ, icon, msg, cat, sv, sid):
        return df.select(F.lit(rank).alias("source_rank"), sv.cast("double").alias("sort_value"),
                         sid.cast("long").alias("sort_id"), typ.alias("type"), F.lit(icon).alias("icon"),
                         msg.alias("msg"), F.lit(cat).alias("category"))

    lp = low_stock(p, "stock", "min_stock", 10, require_active=True)
    a1 = shape(lp, 1, F.when(F.col("stock") == 0, "danger").otherwise("warning"), ICONS["product"],
               F.when(F.col("stock") == 0, F.format_string(NOTIFY["product_out"], "name"))
               .otherwise(F.format_string(NOTIFY["product_low"], F.col("name"), F.col("stock").cast("string"),
                                          F.col("min_stock").cast("string"))),
               "stock", F.col("stock"), F.col("id"))
    lm = low_stock(m, "quantity", "min_quantity", 10, require_active=False)
    a2 = shape(lm, 2, F.when(F.col("quantity") == 0, "danger").otherwise("warning"), ICONS["material"],
               F.when(F.col("quantity") == 0, F.format_string(NOTIFY["material_out"], "name"))
               .otherwise(F.format_string(NOTIFY["material_low"], F.col("name"), js_number(F.col("quantity")),
                                          js_number(F.col("min_quantity")))),
               "stock", F.col("quantity"), F.col("id"))
    od = overdue_orders(o, c, as_of, 10)
    a3 = shape(od, 3, F.lit("danger"), ICONS["overdue"],
               F.format_string(NOTIFY["overdue"], F.col("order_number"), F.col("customer")), "payment",
               F.unix_date("due_date"), F.col("id"))
    pend = po.where(F.col("status") == "pending").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    a4 = shape(pend, 4, F.lit("info"), ICONS["production"], F.format_string(NOTIFY["production"], F.col("n")),
               "production", F.lit(0), F.lit(0))
    md = maintenance_due(e, ev_day, 7, active_only=True)
    a5 = shape(md, 5, F.lit("warning"), ICONS["maintenance"], F.format_string(NOTIFY["maintenance"], F.col("name")),
               "maintenance", F.lit(0), F.col("id"))
    dp = deposit_alerts(cd, c, 5, 5)
    a6 = shape(dp, 6, F.lit("info"), ICONS["deposit"],
               F.format_string(NOTIFY["deposit"], F.col("name"), F.col("outstanding").cast("string")), "deposit",
               -F.col("outstanding"), F.col("customer_id"))
    return a1.unionByName(a2).unionByName(a3).unionByName(a4).unionByName(a5).unionByName(a6) \
        .orderBy("source_rank", "sort_value", "sort_id")


def notification_badge(notes: DataFrame) -> DataFrame:
    """the alert count and the badge text (``9+`` above nine, hidden at 0)."""
    n = notes.agg(F.count(F.lit(1)).alias("count"))
    return n.select("count", F.when(F.col("count") > 9, "9+").when(F.col("count") > 0, F.col("count").cast("string"))
                    .alias("badge"))
