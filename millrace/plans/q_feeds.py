"""Registered 2F feed queries and their oracles."""

from __future__ import annotations

from millrace.operators import feeds as FD
from millrace.plans.catalog import AS_OF, AS_OF_EVENTS, register

_JSNUM = "rtrim(rtrim(CAST(CAST({} AS DECIMAL(38,10)) AS VARCHAR), '0'), '.')".format


F1_SQL = """
WITH everything AS (
  SELECT 0 AS source_rank, 5 AS room, id, created_at, 'sale' AS type, order_number AS ref,
         (SELECT name FROM customers WHERE customers.id = customer_id) AS who, CAST(total_amount AS DOUBLE) AS amount, status
  FROM sales_orders
  UNION ALL
  SELECT 1, 4, id, created_at, 'material', CASE type WHEN 'in' THEN 'รับเข้า' ELSE 'เบิกออก' END,
         (SELECT name FROM raw_materials WHERE raw_materials.id = material_id), quantity, NULL FROM material_logs
  UNION ALL
  SELECT 2, 4, id, created_at, 'production', status,
         (SELECT name FROM products WHERE products.id = product_id), quantity_planned, status FROM production_orders),
newest AS (SELECT * FROM everything WHERE who IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY source_rank ORDER BY created_at DESC, id DESC) <= room)
SELECT type, CASE source_rank WHEN 0 THEN ref ELSE who END AS ref, CASE source_rank WHEN 0 THEN who ELSE ref END AS detail, amount, status,
       created_at, source_rank, id
FROM newest QUALIFY row_number() OVER (ORDER BY created_at DESC, source_rank, id DESC) <= 12
"""


@register("f1_activity_feed", F1_SQL)
def f1(t):
    return FD.activity_feed(t.sales_orders, t.customers, t.material_logs, t.raw_materials, t.production_orders,
                            t.products, 12)


def _alert(rank: int, value: str, key: str, kind: str, icon: str, msg: str, group: str, source: str) -> str:
    return (f"SELECT {rank} AS source_rank, CAST({value} AS DOUBLE) AS sort_value, CAST({key} AS BIGINT) AS sort_id, {kind} AS type, "
            f"'{icon}' AS icon, {msg} AS msg, '{group}' AS category FROM {source}")


def _short(table: str, have: str, least: str, keep: str) -> str:
    """The ten rows of a stock table that are lowest among those at or under their minimum."""
    return (f"(SELECT *, {have} = 0 AS none FROM {table} WHERE {least} - {have} >= 0 AND {keep} "
            f"QUALIFY row_number() OVER (ORDER BY {have}, id) <= 10)")


_DANGER = "if(none, 'danger', 'warning')"
F2_SQL = " UNION ALL ".join([
    _alert(1, "stock", "id", _DANGER, "droplet-half",
           "if(none, format('สินค้า \"{}\" หมดสต็อก', name), format('สินค้า \"{}\" สต็อกต่ำ ({}/{})', name, stock, min_stock))",
           "stock", _short("products", "stock", "min_stock", "active = 1")),
    _alert(2, "quantity", "id", _DANGER, "boxes",
           f"if(none, format('วัตถุดิบ \"{{}}\" หมด', name), format('วัตถุดิบ \"{{}}\" ใกล้หมด ({{}}/{{}})', name, "
           f"{_JSNUM('quantity')}, {_JSNUM('min_quantity')}))", "stock", _short("raw_materials", "quantity", "min_quantity", "TRUE")),
    _alert(3, "due_date - DATE '1970-01-01'", "id", "'danger'", "exclamation-circle-fill",
           "format('ใบ {} ({}) เกินกำหนดชำระ', order_number, who)", "payment",
           f"(SELECT id, order_number, due_date, (SELECT name FROM customers WHERE customers.id = customer_id) AS who FROM sales_orders "
           f"WHERE due_date < DATE '{AS_OF}' AND status IN ('pending', 'confirmed', 'delivered') AND who IS NOT NULL "
           "QUALIFY row_number() OVER (ORDER BY due_date, id) <= 10)"),
    _alert(4, "0", "0", "'info'", "gear-wide-connected", "format('ใบสั่งผลิตรอดำเนินการ {} รายการ', n)", "production",
           "(SELECT count(*) FILTER (status = 'pending') AS n FROM production_orders) WHERE n > 0"),
    _alert(5, "0", "id", "'warning'", "wrench-adjustable", "format('เครื่อง \"{}\" ถึงกำหนดซ่อมบำรุง', name)", "maintenance",
           f"equipment WHERE status = 'active' AND next_maintenance - 7 <= DATE '{AS_OF_EVENTS}'"),
    _alert(6, "-left_out", "who", "'info'", "archive", "format('{} ค้างถัง {} ใบ', name, left_out)", "deposit",
           "(SELECT who, name, left_out FROM (SELECT customer_id AS who, CAST(sum(ifnull(quantity_out, 0) - ifnull(quantity_returned, 0)) AS BIGINT) "
           "AS left_out FROM container_deposits GROUP BY customer_id) JOIN customers ON id = who WHERE left_out > 5 "
           "QUALIFY row_number() OVER (ORDER BY left_out DESC, who) <= 5)"),
])


@register("f2_notifications", F2_SQL)
def f2(t):
    return FD.notifications(t.products, t.raw_materials, t.sales_orders, t.customers, t.production_orders,
                            t.equipment, t.container_deposits, AS_OF, AS_OF_EVENTS)


@register("f2_notification_badge", f"""
SELECT COUNT(*) AS count, CASE WHEN COUNT(*) > 9 THEN '9+' WHEN COUNT(*) > 0 THEN CAST(COUNT(*) AS VARCHAR) END AS badge
FROM ({F2_SQL}) n
""")
def f2_badge(t):
    return FD.notification_badge(FD.notifications(t.products, t.raw_materials, t.sales_orders, t.customers,
                                                  t.production_orders, t.equipment, t.container_deposits,
                                                  AS_OF, AS_OF_EVENTS))
