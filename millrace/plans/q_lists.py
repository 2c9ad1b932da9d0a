"""Registered 2C / 2G queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lists as C
from millrace.operators import numbering as G
from millrace.operators import reports as R
from millrace.plans.catalog import AS_OF, AS_OF_EVENTS, EV_FROM, register
from millrace.plans.q_filters import BATCH_SQL


def _name(table: str, key: str, column: str = "name") -> str:
    """A name looked up by key; NULL where there is none."""
    return f"(SELECT x.{column} FROM {table} x WHERE x.id = {key})"


def _known(table: str, key: str) -> str:
    return f"{key} IN (SELECT id FROM {table})"


C1_SQL = f"""
SELECT *, {_name('customers', 'customer_id')} AS customer_name, {_name('customers', 'customer_id', 'phone')} AS customer_phone,
       {_name('users', 'created_by')} AS created_by_name
FROM sales_orders WHERE {_known('customers', 'customer_id')}
"""


@register("c1_sales_list", C1_SQL)
def c1(t):
    return C.sales_list(t.sales_orders, t.customers, t.users)


@register("c1_sales_list_filtered", C1_SQL + """
  AND status = 'delivered' AND order_date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'
""")
def c1f(t):
    return C.sales_list(t.sales_orders, t.customers, t.users, status="delivered", date_from="1998-01-01",
                        date_to="1999-06-30")


@register("c2_recent_orders", """
SELECT id, order_number, who AS customer_name, total_amount, status, order_date, created_at
FROM sales_orders, (SELECT id AS cid, name AS who FROM customers) WHERE cid = customer_id
QUALIFY row_number() OVER (ORDER BY created_at DESC, id DESC) <= 5
""")
def c2(t):
    return C.recent_orders(t.sales_orders, t.customers, 5)


def _text(*cols: str) -> str:
    return "concat_ws(':', " + ", ".join(f"ifnull(CAST({c} AS VARCHAR), '-')" for c in cols) + ")"


def _money(c: str, places: int = 2) -> str:
    return f"CAST({c} AS DECIMAL(18,{places}))"


@register("c3_sales_documents", f"""
WITH it AS (
  SELECT order_id, COUNT(*) AS item_count, CAST(SUM(quantity) AS BIGINT) AS item_qty,
         string_agg({_text('product_id', _name('products', 'product_id'), _name('products', 'product_id', 'unit'), 'quantity',
                           _money('subtotal'), _money('unit_price * quantity'))}, '|' ORDER BY product_id, subtotal) AS item_keys
  FROM sales_items GROUP BY order_id),
pa AS (SELECT order_id, COUNT(*) AS payment_count,
              string_agg({_text('id', _money('amount', 4), 'payment_date', 'method', _name('users', 'created_by'))}, '|' ORDER BY payment_date, id)
         AS payment_ids FROM payments GROUP BY order_id),
de AS (SELECT order_id, min(id) AS delivery_id, arg_min(status, id) AS delivery_status, arg_min(driver_name, id) AS driver_name,
              arg_min(delivery_date, id) AS delivery_date FROM deliveries GROUP BY order_id)
SELECT so.id AS order_id, so.order_number, c.name AS customer_name, so.total_amount,
       so.total_amount - so.paid_amount AS outstanding,
       CAST(COALESCE(it.item_count, 0) AS INTEGER) AS item_count, COALESCE(it.item_qty, 0) AS item_qty,
       COALESCE(it.item_keys, '') AS item_keys, CAST(COALESCE(pa.payment_count, 0) AS INTEGER) AS payment_count,
       COALESCE(pa.payment_ids, '') AS payment_ids, de.delivery_id, de.delivery_status, de.driver_name, de.delivery_date
FROM sales_orders so JOIN customers c ON so.customer_id = c.id
LEFT JOIN it ON it.order_id = so.id LEFT JOIN pa ON pa.order_id = so.id LEFT JOIN de ON de.order_id = so.id
""")
def c3(t):
    return C.document_summary(C.sales_documents(t.sales_orders, t.customers, t.sales_items, t.products, t.payments,
                                                t.users, t.deliveries))


PROD_LIST = f"""
SELECT *, {_name('products', 'product_id')} AS product_name, {_name('products', 'product_id', 'unit')} AS unit,
       {_name('users', 'created_by')} AS by_name
FROM production_orders WHERE {_known('products', 'product_id')}
"""


@register("c4_production_list", PROD_LIST)
def c4(t):
    return C.production_list(t.production_orders, t.products, t.users)


@register("c5_production_report_rows", PROD_LIST + f"""
  AND CAST(created_at AS DATE) BETWEEN DATE '{EV_FROM}' AND DATE '{AS_OF_EVENTS}'
""")
def c5(t):
    return C.production_report_rows(t.production_orders, t.products, t.users, EV_FROM, AS_OF_EVENTS)


@register("c6_deliveries_list", """
SELECT d.*, so.order_number, so.total_amount, c.name AS customer_name
FROM deliveries d JOIN sales_orders so ON d.order_id = so.id JOIN customers c ON so.customer_id = c.id
""")
def c6(t):
    return C.deliveries_list(t.deliveries, t.sales_orders, t.customers)


@register("c7_qc_list", f"""
WITH pob AS ({BATCH_SQL})
SELECT qt.*, po.batch_number, p.name AS product_name, u.name AS created_by_name
FROM water_quality_tests qt LEFT JOIN pob po ON qt.production_order_id = po.id
LEFT JOIN products p ON po.product_id = p.id LEFT JOIN users u ON qt.created_by = u.id
""")
def c7(t):
    return C.qc_list(t.water_quality_tests, G.assign_batch_numbers(t.production_orders), t.products, t.users)


@register("d18_qc_report_rows", f"""
WITH pob AS ({BATCH_SQL})
SELECT qt.*, pob.batch_number, {_name('products', 'pob.product_id')} AS product_name, {_name('users', 'qt.created_by')} AS created_by_name
FROM water_quality_tests qt LEFT JOIN pob ON pob.id = qt.production_order_id
WHERE test_date BETWEEN DATE '{EV_FROM}' AND DATE '{AS_OF_EVENTS}'
""")
def d18_rows(t):
    return C.qc_list(R.qc_in(t.water_quality_tests, EV_FROM, AS_OF_EVENTS), G.assign_batch_numbers(t.production_orders), t.products,
                     t.users).orderBy(F.desc("test_date"), F.desc("id"))


@register("c8_bom_lines", """
SELECT b.*, m.name AS material_name, m.unit, m.cost_per_unit, m.quantity AS stock
FROM product_bom b JOIN raw_materials m ON b.material_id = m.id
""")
def c8(t):
    return C.bom_lines(t.product_bom, t.raw_materials)


@register("c9_purchase_orders_list", f"""
SELECT *, {_name('suppliers', 'supplier_id')} AS supplier_name, {_name('users', 'created_by')} AS created_by_name
FROM purchase_orders WHERE {_known('suppliers', 'supplier_id')}
""")
def c9(t):
    return C.purchase_orders_list(t.purchase_orders, t.suppliers, t.users)


@register("c10_purchase_documents", f"""
WITH it AS (
  SELECT po_id, COUNT(*) AS item_count,
         string_agg({_text('material_id', _name('raw_materials', 'material_id'), _name('raw_materials', 'material_id', 'unit'),
                           'CAST(quantity AS BIGINT)', _money('subtotal'), _money('unit_price * quantity'))}, '|' ORDER BY material_id, subtotal) AS item_keys
  FROM purchase_items GROUP BY po_id)
SELECT po.id, po.po_number, s.name AS supplier_name, po.total_amount,
       CAST(COALESCE(it.item_count, 0) AS INTEGER) AS item_count, COALESCE(it.item_keys, '') AS item_keys
FROM purchase_orders po JOIN suppliers s ON po.supplier_id = s.id LEFT JOIN it ON it.po_id = po.id
""")
def c10(t):
    d = C.purchase_documents(t.purchase_orders, t.suppliers, t.purchase_items, t.raw_materials)
    items = F.coalesce(F.col("items"), F.array())
    return d.select("id", "po_number", "supplier_name", "total_amount", F.size(items).alias("item_count"),
                    F.concat_ws("|", F.transform(items, lambda x: F.concat_ws(":", *[F.coalesce(v.cast("string"), F.lit("-")) for v in (
                        x["material_id"], x["material_name"], x["unit"], x["quantity"].cast("bigint"), x["subtotal"].cast("decimal(18,2)"),
                        (x["unit_price"] * x["quantity"]).cast("decimal(18,2)"))]))).alias("item_keys"))


@register("c11_material_history", """
SELECT ml.*, CAST(row_number() OVER (PARTITION BY material_id ORDER BY created_at DESC, ml.id DESC) AS INTEGER) AS rn,
       u.name AS by_name
FROM material_logs ml LEFT JOIN users u ON ml.created_by = u.id
QUALIFY rn <= 100
""")
def c11(t):
    return C.material_history(t.material_logs, t.users, None, 100)


@register("c12_maintenance_history", """
SELECT ml.*, u.name AS by_name FROM maintenance_logs ml LEFT JOIN users u ON ml.created_by = u.id
""")
def c12(t):
    return C.maintenance_history(t.maintenance_logs, t.users)


@register("c13_equipment_status", """
WITH g AS (SELECT equipment_id, COUNT(*) AS n, arg_max(id, (performed_date, id)) AS log_id,
                  max(performed_date) AS performed_date, arg_max((maintenance_type, cost, next_due), (performed_date, id)) AS rest
           FROM maintenance_logs GROUP BY equipment_id)
SELECT e.*, COALESCE(g.n, 0) AS maintenance_count, g.log_id AS last_log_id, g.performed_date AS last_performed_date,
       rest[1] AS last_type, rest[2] AS last_cost, rest[3] AS last_next_due
FROM equipment e LEFT JOIN g ON g.equipment_id = e.id
""")
def c13(t):
    s = C.equipment_status(t.equipment, t.maintenance_logs)
    return s.select(*[c for c in s.columns if c != "last_log"], F.col("last_log.log_id").alias("last_log_id"),
                    F.col("last_log.performed_date").alias("last_performed_date"),
                    F.col("last_log.maintenance_type").alias("last_type"), F.col("last_log.cost").alias("last_cost"),
                    F.col("last_log.next_due").alias("last_next_due"))


@register("c14_deposits_list", """
SELECT cd.*, c.name AS customer_name, c.phone AS customer_phone, u.name AS created_by_name
FROM container_deposits cd JOIN customers c ON cd.customer_id = c.id LEFT JOIN users u ON cd.created_by = u.id
""")
def c14(t):
    return C.deposits_list(t.container_deposits, t.customers, t.users)


@register("c15_returns_list", """
SELECT r.*, p.name AS product_name, so.order_number, u.name AS created_by_name
FROM returns r LEFT JOIN products p ON r.product_id = p.id LEFT JOIN sales_orders so ON r.order_id = so.id
LEFT JOIN users u ON r.created_by = u.id
""")
def c15(t):
    return C.returns_list(t.returns, t.products, t.sales_orders, t.users)


@register("c16_routes_list", f"""
WITH stops AS (SELECT route_id AS rid, count(*) AS n FROM delivery_route_orders GROUP BY route_id)
SELECT delivery_routes.*, {_name('users', 'created_by')} AS created_by_name, ifnull(n, 0) AS order_count
FROM delivery_routes LEFT JOIN stops ON rid = id
""")
def c16(t):
    return C.routes_list(t.delivery_routes, t.delivery_route_orders, t.users)


@register("c17_route_documents", """
SELECT dro.*, dr.route_name, dr.delivery_date, dr.status AS route_status, so.order_number, so.total_amount,
       so.status AS order_status, c.name AS customer_name, c.phone AS customer_phone
FROM delivery_route_orders dro JOIN delivery_routes dr ON dro.route_id = dr.id
JOIN sales_orders so ON dro.order_id = so.id JOIN customers c ON so.customer_id = c.id
""")
def c17(t):
    return C.route_documents(t.delivery_routes, t.delivery_route_orders, t.sales_orders, t.customers)


@register("c18_expenses_list", """
SELECT e.*, u.name AS created_by_name FROM expenses e LEFT JOIN users u ON e.created_by = u.id
""")
def c18(t):
    return C.expenses_list(t.expenses, t.users)


@register("c19_orders_awaiting_delivery", """
SELECT * FROM sales_orders so WHERE so.status IN ('pending', 'confirmed')
  AND NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.order_id = so.id)
""")
def c19(t):
    return C.orders_awaiting_delivery(t.sales_orders, t.deliveries)


@register("f3_union_status", "SELECT * FROM sales_orders WHERE status IN ('pending', 'confirmed')")
def f3(t):
    return C.union_status(t.sales_orders)


@register("g1_assign_document_numbers", f"""
WITH old AS (SELECT max(id) AS m FROM sales_orders WHERE created_at < TIMESTAMP '{AS_OF} 00:00:00'),
nw AS (SELECT * FROM sales_orders WHERE created_at >= TIMESTAMP '{AS_OF} 00:00:00')
SELECT nw.*, CAST(COALESCE(old.m, 0) + row_number() OVER (ORDER BY created_at, id) AS BIGINT) AS seq_no,
       printf('SO%05d', COALESCE(old.m, 0) + row_number() OVER (ORDER BY created_at, id)) AS doc_number
FROM nw, old
""")
def g1(t):
    so = t.sales_orders
    cut = F.to_timestamp_ntz(F.lit(f"{AS_OF} 00:00:00"))
    start = so.where(F.col("created_at") < cut).agg(F.max("id")).scalar()
    return G.assign_document_numbers(so.where(F.col("created_at") >= cut), "SO", start)


@register("g2_assign_batch_numbers", BATCH_SQL)
def g2(t):
    return G.assign_batch_numbers(t.production_orders)


@register("g3_route_sequence", """
SELECT order_id, product_id AS order_id_item,
       CAST(row_number() OVER (PARTITION BY order_id ORDER BY product_id, subtotal) AS INTEGER) AS sequence_number,
       CAST(COUNT(*) OVER (PARTITION BY order_id) AS INTEGER) AS total_orders
FROM sales_items
""")
def g3(t):
    # the UI posts an ordered id list per parent; here: each order's product ids in line order
    arr = t.sales_items.groupBy("order_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("product_id", "subtotal"))),
                    lambda s: s["product_id"]).alias("ids"))
    seq = G.route_sequence(arr.withColumnRenamed("order_id", "parent_id"), "ids", "parent_id")
    return seq.select(F.col("parent_id").alias("order_id"), F.col("order_id").alias("order_id_item"),
                      "sequence_number", "total_orders")
