"""Registered 2B / 2E queries and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import filters as B
from millrace.operators import numbering as G
from millrace.operators.search_index import TrigramIndex, indexed_contains, indexed_search
from millrace.plans.catalog import AS_OF, AS_OF_EVENTS, EV_FROM, PLAIN, register
from millrace.session import ensure_checkpoint_dir

SEARCH_Q = "cUsToMeR#00000012"
_UP, _LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _like(col: str, q: str) -> str:
    return f"translate({col}, '{_UP}', '{_LO}') LIKE '%{q.lower()}%'"


@register("b1_active_products", "SELECT * FROM products WHERE active = 1")
def b1p(t):
    return B.active_only(t.products)


@register("b1_active_customers", "SELECT * FROM customers WHERE active = 1")
def b1c(t):
    return B.active_only(t.customers)


@register("b1_active_suppliers", "SELECT * FROM suppliers WHERE active = 1")
def b1s(t):
    return B.active_only(t.suppliers)


@register("b2_materials_list", "SELECT * FROM raw_materials")
def b2m(t):
    return B.materials_list(t.raw_materials)


@register("b2_equipment_list", "SELECT * FROM equipment")
def b2e(t):
    return B.equipment_list(t.equipment)


@register("b3_users_public", "SELECT id, username, name, role, active FROM users")
def b3(t):
    return B.users_public(t.users)


@register("b4_sales_filter", """
SELECT * FROM sales_orders WHERE status = 'confirmed' AND order_date >= DATE '1996-01-01'
  AND order_date <= DATE '1997-12-31'
""")
def b4(t):
    return B.sales_filter(t.sales_orders, "confirmed", "1996-01-01", "1997-12-31", None)


@register("b4_sales_filter_customer", "SELECT * FROM sales_orders WHERE customer_id = 7")
def b4c(t):
    return B.sales_filter(t.sales_orders, None, None, None, 7)


@register("b5_expenses_filter", f"""
SELECT * FROM expenses WHERE expense_date >= DATE '{EV_FROM}' AND expense_date <= DATE '{AS_OF_EVENTS}'
  AND category = 'water'
""")
def b5(t):
    return B.expenses_filter(t.expenses, EV_FROM, AS_OF_EVENTS, "water")


@register("b6_expenses_of_month", "SELECT * FROM expenses WHERE strftime(expense_date, '%Y-%m') = '2024-01'")
def b6(t):
    return B.expenses_of_month(t.expenses, "2024-01")


@register("b7_status_not_in", "SELECT * FROM sales_orders WHERE status NOT IN ('paid', 'cancelled')")
def b7(t):
    return B.status_filter(t.sales_orders, ["paid", "cancelled"], negate=True)


@register("b7_status_in", "SELECT * FROM production_orders WHERE status IN ('pending', 'in_progress')")
def b7i(t):
    return B.status_filter(t.production_orders, ["pending", "in_progress"])


@register("b8_low_stock_products", """
SELECT * FROM products WHERE stock <= min_stock AND active = 1 ORDER BY stock ASC, id LIMIT 10
""")
def b8p(t):
    return B.low_stock(t.products, "stock", "min_stock", 10)


@register("b8_low_stock_materials", """
SELECT * FROM raw_materials WHERE quantity <= min_quantity ORDER BY quantity ASC, id LIMIT 10
""")
def b8m(t):
    return B.low_stock(t.raw_materials, "quantity", "min_quantity", 10)


@register("b9_overdue_orders", f"""
SELECT id, order_number, (SELECT name FROM customers WHERE customers.id = customer_id) AS customer, due_date
FROM sales_orders WHERE due_date < DATE '{AS_OF}' AND status IN ('pending', 'confirmed', 'delivered')
  AND customer_id IN (SELECT id FROM customers)
QUALIFY row_number() OVER (ORDER BY due_date, id) <= 10
""")
def b9(t):
    return B.overdue_orders(t.sales_orders, t.customers, AS_OF, 10)


@register("b10_maintenance_due", f"""
SELECT * FROM equipment WHERE next_maintenance IS NOT NULL
  AND next_maintenance <= DATE '{AS_OF_EVENTS}' + INTERVAL 7 DAY AND status = 'active'
""")
def b10(t):
    return B.maintenance_due(t.equipment, AS_OF_EVENTS, 7, active_only=True)


@register("b10_maintenance_due_any_status", f"""
SELECT * FROM equipment WHERE next_maintenance IS NOT NULL
  AND next_maintenance <= DATE '{AS_OF_EVENTS}' + INTERVAL 7 DAY
""")
def b10a(t):
    return B.maintenance_due(t.equipment, AS_OF_EVENTS, 7, active_only=False)


@register("b11_global_search", f"""
WITH hits AS (
  SELECT 'customers' AS grp, id, id AS place, code, name, phone, type FROM customers
  WHERE active = 1 AND ({_like('name', SEARCH_Q)} OR {_like('code', SEARCH_Q)} OR {_like('phone', SEARCH_Q)})
  UNION ALL BY NAME
  SELECT 'products' AS grp, id, id AS place, code, name, stock, unit, price FROM products
  WHERE active = 1 AND ({_like('name', SEARCH_Q)} OR {_like('code', SEARCH_Q)})
  UNION ALL BY NAME
  SELECT 'orders' AS grp, o.id, row_number() OVER (ORDER BY created_at DESC, o.id DESC) AS place, order_number AS code, total_amount, status,
         order_date, customer_name
  FROM sales_orders o, (SELECT id AS cid, name AS customer_name FROM customers) WHERE cid = customer_id
    AND ({_like('order_number', SEARCH_Q)} OR {_like('customer_name', SEARCH_Q)}))
SELECT * EXCLUDE place FROM hits QUALIFY row_number() OVER (PARTITION BY grp ORDER BY place) <= 5
""")
def b11(t):
    return B.global_search(t.customers, t.products, t.sales_orders, SEARCH_Q, 5)


@register("b12_contains_filter", """
SELECT * FROM customers
WHERE (contains(lower(COALESCE(name, '')), 'customer#0000001') OR contains(lower(COALESCE(code, '')), 'customer#0000001')
       OR contains(lower(COALESCE(phone, '')), 'customer#0000001')) AND type = 'retail'
""")
def b12(t):
    return B.contains_filter(t.customers, ["name", "code", "phone"], "Customer#0000001", "retail")


def _index(t, table, cols: list[str], fold: str = "like") -> TrigramIndex:
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/stored/grams-{uuid.uuid4().hex}"
    index = TrigramIndex(t.spark, path, cols, fold, buckets=16)
    index.build(0, table)
    return index


@register("b11_indexed_search", PLAIN["b11_global_search"])
def b11_indexed(t):
    c, p, o = t.customers, t.products, t.sales_orders
    return indexed_search(c, p, o, _index(t, c, ["name", "code", "phone"]), _index(t, p, ["name", "code"]),
                          _index(t, o, ["order_number"]), SEARCH_Q, 5)


@register("b12_indexed_contains", PLAIN["b12_contains_filter"])
def b12_indexed(t):
    cols = ["name", "code", "phone"]
    return indexed_contains(t.customers, _index(t, t.customers, cols, "lower"), cols, "Customer#0000001", "retail")


BATCH_SQL = """
SELECT *, printf('B%s-%03d', strftime(CAST(created_at AS DATE), '%Y%m%d'),
                 1 + COALESCE(SUM(CASE WHEN status <> 'cancelled' THEN 1 ELSE 0 END) OVER (
                   PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS batch_number,
       CAST(CAST(created_at AS DATE) + INTERVAL 365 DAY AS DATE) AS expiry_date
FROM production_orders
"""


@register("b13_batches_with_number", f"SELECT * FROM ({BATCH_SQL}) b WHERE batch_number IS NOT NULL AND batch_number <> ''")
def b13(t):
    return B.batches_with_number(G.assign_batch_numbers(t.production_orders))


@register("e1_top_k_expenses", "SELECT * FROM expenses ORDER BY amount DESC, id LIMIT 10")
def e1(t):
    return B.top_k(t.expenses, [F.desc("amount"), "id"], 10)


@register("e2_audit_latest", "SELECT * FROM audit_logs ORDER BY created_at DESC, id DESC LIMIT 200")
def e2(t):
    return B.audit_latest(t.audit_logs, 200)


@register("e3_multi_key_sort", "SELECT * FROM expenses")
def e3(t):
    return B.multi_key_sort(t.expenses, [F.desc("expense_date"), F.desc("created_at")])


@register("b14_sales_summary_default_range", f"""
SELECT COUNT(*) AS orders, COALESCE(CAST(SUM(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE), 0) AS revenue,
       COALESCE(CAST(SUM(CAST(paid_amount AS DECIMAL(18,4))) AS DOUBLE), 0) AS paid,
       COALESCE(CAST(SUM(CAST(total_amount - paid_amount AS DECIMAL(18,4))) AS DOUBLE), 0) AS unpaid
FROM sales_orders WHERE order_date BETWEEN DATE '{AS_OF[:8]}01' AND DATE '{AS_OF}' AND status <> 'cancelled'
""")
def b14(t):
    from millrace.operators.reports import sales_summary
    lo, hi = B.date_range_default(None, None, AS_OF)
    return sales_summary(t.sales_orders, lo, hi)
