"""Registered 2D report queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import refresh as V
from millrace.operators import reports as R
from millrace.plans.catalog import AS_OF, AS_OF_EVENTS, EV_FROM, EV_TO, FROM, PLAIN, TO, register

DEC = "CAST({} AS DECIMAL(18,4))".format
#: the oracles' building blocks: what counts as sold, added up per key before any name is looked up
SOLD = f"""
sold AS (SELECT id, customer_id, order_date AS day, {DEC('total_amount')} AS amount, {DEC('paid_amount')} AS paid,
                {DEC('total_amount - paid_amount')} AS due
         FROM sales_orders WHERE status <> 'cancelled' AND order_date >= DATE '{FROM}' AND order_date <= DATE '{TO}')"""
SOLD_ITEMS = SOLD + f""",
sold_items AS (SELECT product_id, sum(quantity) AS units, sum({DEC('subtotal')}) AS amount
               FROM sales_items WHERE order_id IN (SELECT id FROM sold) GROUP BY product_id)"""
D6_SQL = f"""
WITH {SOLD_ITEMS}
SELECT product_id, p.code, p.name, CAST(units AS BIGINT) AS quantity, CAST(amount AS DOUBLE) AS revenue
FROM sold_items, products p WHERE p.id = product_id
"""


@register("d1_dashboard_kpis", f"""
SELECT
  (SELECT COALESCE(CAST(SUM(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE), 0) FROM sales_orders
     WHERE order_date = DATE '{AS_OF}' AND status <> 'cancelled') AS today_sales,
  (SELECT COALESCE(CAST(SUM(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE), 0) FROM sales_orders
     WHERE strftime(order_date, '%Y-%m') = '{AS_OF[:7]}' AND status <> 'cancelled') AS month_sales,
  (SELECT COUNT(*) FROM sales_orders WHERE status IN ('pending', 'confirmed')) AS pending_orders,
  (SELECT COALESCE(CAST(SUM(CAST(total_amount - paid_amount AS DECIMAL(18,4))) AS DOUBLE), 0) FROM sales_orders
     WHERE status NOT IN ('paid', 'cancelled')) AS unpaid_amount,
  (SELECT COUNT(*) FROM customers WHERE active = 1) AS total_customers,
  (SELECT COUNT(*) FROM products WHERE active = 1) AS total_products,
  (SELECT COUNT(*) FROM products WHERE stock <= min_stock AND active = 1) AS low_stock,
  (SELECT COUNT(*) FROM production_orders WHERE status IN ('pending', 'in_progress')) AS pending_production,
  (SELECT COUNT(*) FROM raw_materials WHERE quantity <= min_quantity) AS low_materials
""")
def d1(t):
    return R.dashboard_kpis(t.sales_orders, t.customers, t.products, t.production_orders, t.raw_materials, AS_OF)


@register("d2_sales_last_days", f"""
SELECT CAST(d.date AS DATE) AS date, COALESCE(s.total, 0) AS total
FROM (SELECT unnest(generate_series(DATE '{AS_OF}' - INTERVAL 6 DAY, DATE '{AS_OF}', INTERVAL 1 DAY)) AS date) d
LEFT JOIN (SELECT order_date, CAST(SUM(CAST(total_amount AS DECIMAL(18,4))) AS DOUBLE) AS total FROM sales_orders
           WHERE order_date >= DATE '{AS_OF}' - INTERVAL 6 DAY AND order_date <= DATE '{AS_OF}'
             AND status <> 'cancelled' GROUP BY order_date) s ON s.order_date = CAST(d.date AS DATE)
""")
def d2(t):
    return R.sales_last_days(t.spark, t.sales_orders, AS_OF, 7)


@register("d3_top_products", f"""
WITH month AS (SELECT id FROM sales_orders WHERE date_trunc('month', order_date) = DATE '{AS_OF[:7]}-01' AND status <> 'cancelled'),
units AS (SELECT product_id AS pid, sum(quantity) AS n, sum({DEC('subtotal')}) AS v FROM sales_items
          WHERE order_id IN (FROM month) GROUP BY product_id),
placed AS (SELECT units.*, name, row_number() OVER (ORDER BY n DESC, pid) AS place FROM units JOIN products ON id = pid)
SELECT pid AS product_id, name, CAST(n AS BIGINT) AS qty, CAST(v AS DOUBLE) AS total FROM placed WHERE place <= 5
""")
def d3(t):
    return R.top_products(t.sales_orders, t.sales_items, t.products, AS_OF[:7], 5)


@register("d4_sales_summary", f"""
WITH {SOLD},
days AS (SELECT day, count(*) AS n, sum(amount) AS a, sum(paid) AS p, sum(due) AS u FROM sold GROUP BY day)
SELECT CAST(ifnull(sum(n), 0) AS BIGINT) AS orders, CAST(ifnull(sum(a), 0) AS DOUBLE) AS revenue,
       CAST(ifnull(sum(p), 0) AS DOUBLE) AS paid, CAST(ifnull(sum(u), 0) AS DOUBLE) AS unpaid
FROM days
""")
def d4(t):
    return R.sales_summary(t.sales_orders, FROM, TO)


@register("d5_sales_by_day", f"""
WITH {SOLD}
SELECT DISTINCT day AS date, count(*) OVER d AS orders, CAST(sum(amount) OVER d AS DOUBLE) AS revenue FROM sold WINDOW d AS (PARTITION BY day)
""")
def d5(t):
    return R.sales_by_day(t.sales_orders, FROM, TO)


@register("d6_sales_by_product", D6_SQL)
def d6(t):
    return R.sales_by_product(t.sales_orders, t.sales_items, t.products, FROM, TO)


@register("d7_sales_by_customer", f"""
WITH {SOLD},
buyers AS (SELECT customer_id AS who, count(*) AS n, sum(amount) AS a FROM sold GROUP BY customer_id),
placed AS (SELECT who, n, a, code, name, row_number() OVER (ORDER BY a DESC, who) AS place FROM buyers JOIN customers ON id = who)
SELECT who AS customer_id, code, name, n AS orders, CAST(a AS DOUBLE) AS revenue FROM placed WHERE place <= 10
""")
def d7(t):
    return R.sales_by_customer(t.sales_orders, t.customers, FROM, TO, 10)


@register("d8_inventory_valuation", """
SELECT (SELECT COALESCE(CAST(SUM(CAST(stock * cost AS DECIMAL(18,4))) AS DOUBLE), 0) FROM products WHERE active = 1) AS product_value,
       (SELECT COUNT(*) FROM products WHERE active = 1) AS product_items,
       (SELECT COALESCE(CAST(SUM(CAST(quantity * cost_per_unit AS DECIMAL(18,4))) AS DOUBLE), 0) FROM raw_materials) AS material_value,
       (SELECT COUNT(*) FROM raw_materials) AS material_items
""")
def d8(t):
    return R.inventory_valuation(t.products, t.raw_materials)


@register("d8_inventory_items", """
SELECT id, code, name, stock, cost, stock * cost AS value FROM products WHERE active = 1
""")
def d8_items(t):
    return R.inventory_items(t.products)


@register("d9_production_summary", f"""
SELECT COUNT(*) AS total, CAST(SUM(quantity_planned) AS BIGINT) AS planned,
       CAST(SUM(quantity_produced) AS BIGINT) AS produced,
       CAST(SUM(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
       CAST(SUM(CASE WHEN status = 'cancelled' THEN 1 ELSE 0 END) AS BIGINT) AS cancelled
FROM production_orders WHERE CAST(created_at AS DATE) BETWEEN DATE '{EV_FROM}' AND DATE '{AS_OF_EVENTS}'
""")
def d9(t):
    return R.production_summary(t.production_orders, EV_FROM, AS_OF_EVENTS)


PROFIT_SQL = f"""
WITH {SOLD_ITEMS},
priced AS (SELECT product_id, code, name, units, amount, units * {DEC('cost')} AS spent FROM sold_items JOIN products ON id = product_id)
SELECT product_id, code, name, CAST(units AS BIGINT) AS qty, CAST(amount AS DOUBLE) AS revenue, CAST(spent AS DOUBLE) AS cost,
       CAST(amount - spent AS DOUBLE) AS profit
FROM priced
"""


@register("d10_profit_by_product", f"""
SELECT product_id, code, name, qty, revenue, cost, profit,
       CASE WHEN revenue > 0 THEN profit / revenue * 100 ELSE 0 END AS margin_pct
FROM ({PROFIT_SQL}) x
""")
def d10(t):
    return R.profit_by_product(t.sales_orders, t.sales_items, t.products, FROM, TO)


@register("d11_profit_total", f"""
WITH bp AS ({PROFIT_SQL}),
     t AS (SELECT COALESCE(CAST(SUM(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE), 0) AS r, COALESCE(CAST(SUM(CAST(cost AS DECIMAL(18,4))) AS DOUBLE), 0) AS c, COALESCE(CAST(SUM(CAST(profit AS DECIMAL(18,4))) AS DOUBLE), 0) AS p FROM bp)
SELECT r AS revenue, c AS cost, p AS profit,
       CASE WHEN r > 0 THEN p / r * 100 ELSE 0 END AS margin_pct, greatest(p, 0) AS chart_profit
FROM t
""")
def d11(t):
    return R.profit_total(R.profit_by_product(t.sales_orders, t.sales_items, t.products, FROM, TO))


@register("d12_expenses_by_category", f"""
SELECT category, CAST(SUM(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS total, COUNT(*) AS count, false AS is_total
FROM expenses WHERE expense_date BETWEEN DATE '{EV_FROM}' AND DATE '{EV_TO}' GROUP BY category
UNION ALL
SELECT NULL, COALESCE(CAST(SUM(CAST(amount AS DECIMAL(18,4))) AS DOUBLE), 0), COUNT(*), true
FROM expenses WHERE expense_date BETWEEN DATE '{EV_FROM}' AND DATE '{EV_TO}'
""")
def d12(t):
    return R.expenses_by_category(t.expenses, EV_FROM, EV_TO)


@register("d13_expenses_by_month", f"""
SELECT strftime(expense_date, '%Y-%m') AS month, CAST(SUM(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS total
FROM expenses WHERE expense_date BETWEEN DATE '{EV_FROM}' AND DATE '{EV_TO}' GROUP BY 1
""")
def d13(t):
    return R.expenses_by_month(t.expenses, EV_FROM, EV_TO)


@register("d14_expense_month_cards", f"""
SELECT COALESCE(CAST(SUM(CAST(amount AS DECIMAL(18,4))) AS DOUBLE), 0) AS total,
       COALESCE(CAST(SUM(CAST(CASE WHEN category = 'electricity' THEN amount END AS DECIMAL(18,4))) AS DOUBLE), 0) AS electricity,
       COALESCE(CAST(SUM(CAST(CASE WHEN category = 'water' THEN amount END AS DECIMAL(18,4))) AS DOUBLE), 0) AS water,
       COALESCE(CAST(SUM(CAST(CASE WHEN category NOT IN ('electricity', 'water') OR category IS NULL THEN amount END AS DECIMAL(18,4))) AS DOUBLE), 0)
         AS other
FROM expenses WHERE strftime(expense_date, '%Y-%m') = '{AS_OF_EVENTS[:7]}'
""")
def d14(t):
    return R.expense_month_cards(t.expenses, AS_OF_EVENTS[:7])


@register("d15_receivables_by_customer", f"""
WITH owed AS (SELECT customer_id AS who, sum({DEC('total_amount - paid_amount')}) AS open_sum
              FROM sales_orders WHERE status NOT IN ('paid', 'cancelled') GROUP BY customer_id)
SELECT id AS customer_id, code, name, phone, credit_limit, balance,
       CAST(ifnull((SELECT open_sum FROM owed WHERE who = customers.id), 0) AS DOUBLE) AS outstanding
FROM customers WHERE active = 1
""")
def d15(t):
    return R.receivables_by_customer(t.customers, t.sales_orders)


@register("d16_receivables_aging", f"""
WITH aged AS (SELECT customer_id AS who, {DEC('total_amount - paid_amount')} AS due,
                     date_diff('hour', CAST(due_date AS TIMESTAMP), TIMESTAMP '{AS_OF} 00:00:00') / 24.0 AS days
              FROM sales_orders WHERE due_date IS NOT NULL AND status NOT IN ('paid', 'cancelled')),
slots AS (SELECT who, due, CASE WHEN days < 0 THEN 'not due' WHEN days <= 30 THEN 'a' WHEN days >= 31 AND days <= 60 THEN 'b'
                                WHEN days >= 61 AND days <= 90 THEN 'c' WHEN days > 90 THEN 'd' ELSE 'gap' END AS slot FROM aged),
sums AS (SELECT who, map_from_entries(list((slot, total))) AS m FROM (SELECT who, slot, sum(due) AS total FROM slots GROUP BY ALL) GROUP BY who)
SELECT who AS customer_id, name, CAST(ifnull(m['a'], 0) AS DOUBLE) AS d30, CAST(ifnull(m['b'], 0) AS DOUBLE) AS d60,
       CAST(ifnull(m['c'], 0) AS DOUBLE) AS d90, CAST(ifnull(m['d'], 0) AS DOUBLE) AS d90plus, CAST(ifnull(m['gap'], 0) AS DOUBLE) AS unbucketed
FROM sums JOIN customers ON id = who
""")
def d16(t):
    return R.receivables_aging(t.sales_orders, t.customers, f"{AS_OF} 00:00:00")


@register("d17_qc_summary", f"""
SELECT result, COUNT(*) AS count FROM water_quality_tests
WHERE test_date BETWEEN DATE '{EV_FROM}' AND DATE '{EV_TO}' GROUP BY result
""")
def d17(t):
    return R.qc_summary(t.water_quality_tests, EV_FROM, EV_TO)


@register("d18_qc_averages", f"""
SELECT (CAST(SUM(CAST(ph AS DECIMAL(18,4))) AS DOUBLE) / COUNT(ph)) AS avg_ph, (CAST(SUM(CAST(tds AS DECIMAL(18,4))) AS DOUBLE) / COUNT(tds)) AS avg_tds, (CAST(SUM(CAST(turbidity AS DECIMAL(18,4))) AS DOUBLE) / COUNT(turbidity)) AS avg_turbidity
FROM water_quality_tests WHERE test_date BETWEEN DATE '{EV_FROM}' AND DATE '{EV_TO}'
""")
def d18(t):
    return R.qc_averages(t.water_quality_tests, EV_FROM, EV_TO)


@register("d19_qc_cards", """
SELECT COUNT(*) FILTER (WHERE result = 'pass') AS pass_count, COUNT(*) FILTER (WHERE result = 'fail') AS fail_count,
       COUNT(*) FILTER (WHERE result = 'pending') AS pending_count,
       (CAST(SUM(CAST(CASE WHEN ph <> 0 THEN ph END AS DECIMAL(18,4))) AS DOUBLE) / COUNT(CASE WHEN ph <> 0 THEN ph END)) AS avg_ph
FROM water_quality_tests
""")
def d19(t):
    return R.qc_cards(t.water_quality_tests)


DEPOSITS_SQL = f"""
WITH moved AS (SELECT customer_id AS who, sum(quantity_out) AS o, sum(quantity_returned) AS r, sum({DEC('deposit_amount')}) AS d
               FROM container_deposits GROUP BY customer_id)
SELECT who AS customer_id, name, phone, CAST(ifnull(o, 0) AS BIGINT) AS total_out, CAST(ifnull(r, 0) AS BIGINT) AS total_returned,
       CAST(ifnull(o, 0) - ifnull(r, 0) AS BIGINT) AS outstanding, CAST(ifnull(d, 0) AS DOUBLE) AS total_deposit
FROM customers JOIN moved ON who = id
"""


@register("d20_deposits_by_customer", DEPOSITS_SQL)
def d20(t):
    return R.deposits_by_customer(t.container_deposits, t.customers)


@register("d20_deposits_totals", f"""
SELECT CAST(COALESCE(SUM(total_out), 0) AS BIGINT) AS total_out,
       CAST(COALESCE(SUM(total_returned), 0) AS BIGINT) AS total_returned,
       CAST(COALESCE(SUM(total_out), 0) - COALESCE(SUM(total_returned), 0) AS BIGINT) AS outstanding
FROM ({DEPOSITS_SQL}) x
""")
def d20_totals(t):
    return R.deposits_totals(R.deposits_by_customer(t.container_deposits, t.customers))


@register("d21_deposit_alerts", f"""
SELECT customer_id, name, outstanding FROM ({DEPOSITS_SQL}) x
WHERE outstanding > 5 QUALIFY row_number() OVER (ORDER BY outstanding DESC, customer_id) <= 5
""")
def d21(t):
    return R.deposit_alerts(t.container_deposits, t.customers, 5, 5)


@register("d22_stock_level_counts", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE stock > min_stock) AS ok,
       COUNT(*) FILTER (WHERE stock <= min_stock AND stock > 0) AS low, COUNT(*) FILTER (WHERE stock = 0) AS out
FROM products
""")
def d22(t):
    return R.stock_level_counts(t.products, "stock", "min_stock")


@register("d22_material_level_counts", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE quantity > min_quantity) AS ok,
       COUNT(*) FILTER (WHERE quantity <= min_quantity AND quantity > 0) AS low,
       COUNT(*) FILTER (WHERE quantity = 0) AS out
FROM raw_materials
""")
def d22_m(t):
    return R.stock_level_counts(t.raw_materials, "quantity", "min_quantity")


@register("d23_po_cards", """
SELECT COUNT(*) FILTER (WHERE status = 'draft') AS draft, COUNT(*) FILTER (WHERE status = 'approved') AS approved,
       COUNT(*) FILTER (WHERE status = 'received') AS received,
       COALESCE(CAST(SUM(CAST(COALESCE(total_amount, 0) AS DECIMAL(18,4))) AS DOUBLE), 0) AS total_amount
FROM purchase_orders
""")
def d23(t):
    return R.po_cards(t.purchase_orders)


@register("d24_equipment_cards", f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'active') AS active,
       COUNT(*) FILTER (WHERE status = 'maintenance') AS maintenance,
       COUNT(*) FILTER (WHERE next_maintenance IS NOT NULL AND next_maintenance <= DATE '{AS_OF_EVENTS}' + INTERVAL 7 DAY)
         AS due
FROM equipment
""")
def d24(t):
    return R.equipment_cards(t.equipment, AS_OF_EVENTS, 7)


@register("d25_production_kanban", """
SELECT l.lane_rank, l.status, COALESCE(n.cnt, 0) AS count
FROM (SELECT 0 AS lane_rank, 'pending' AS status UNION ALL SELECT 1, 'in_progress' UNION ALL SELECT 2, 'completed'
      UNION ALL SELECT 3, 'cancelled') l
LEFT JOIN (SELECT status, COUNT(*) AS cnt FROM production_orders GROUP BY status) n ON n.status = l.status
""")
def d25(t):
    return R.production_kanban(t.spark, t.production_orders)


@register("d25_kanban_cards", """
SELECT CASE po.status WHEN 'pending' THEN 0 WHEN 'in_progress' THEN 1 WHEN 'completed' THEN 2 ELSE 3 END AS lane_rank,
       po.status, po.id, po.product_id, p.name AS product_name, po.quantity_planned, po.quantity_produced, po.created_at
FROM production_orders po LEFT JOIN products p ON po.product_id = p.id
WHERE po.status IN ('pending', 'in_progress', 'completed', 'cancelled')
""")
def d25_cards(t):
    return R.kanban_cards(t.production_orders, t.products)


@register("d26_customer_outstanding", """
SELECT customer_id, CAST(SUM(CAST(total_amount - paid_amount AS DECIMAL(18,4))) AS DOUBLE) AS outstanding
FROM sales_orders WHERE status NOT IN ('paid', 'cancelled') GROUP BY customer_id
""")
def d26(t):
    return R.customer_outstanding(t.sales_orders)


@register("d27_payments_total", """
SELECT so.id AS order_id, so.total_amount, COALESCE(p.paid, 0) AS paid,
       so.total_amount - COALESCE(p.paid, 0) AS remaining
FROM sales_orders so LEFT JOIN (SELECT order_id, CAST(SUM(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS paid FROM payments GROUP BY order_id) p
  ON p.order_id = so.id
""")
def d27(t):
    return R.payments_total(t.payments, t.sales_orders)


@register("d28_max_id", "SELECT CAST(COALESCE(MAX(id), 0) AS BIGINT) AS max_id FROM sales_orders")
def d28(t):
    return R.max_id(t.sales_orders)


@register("d28_daily_count", f"""
SELECT COUNT(*) AS count FROM production_orders
WHERE CAST(created_at AS DATE) = DATE '{AS_OF_EVENTS}' AND status <> 'cancelled'
""")
def d28_daily(t):
    return R.daily_count(t.production_orders, AS_OF_EVENTS)


# ----------------------------------------------------------------------------- refreshed views
#: the oracles' tables after the changes: pending orders are cancelled, inactive customers come back
CHANGED = """WITH so2 AS (SELECT * EXCLUDE (status), CASE WHEN status = 'pending' THEN 'cancelled' ELSE status END AS status FROM sales_orders),
cu2 AS (SELECT * EXCLUDE (active), 1 AS active FROM customers)
"""


def _changed(sql: str) -> str:
    return CHANGED + sql.replace("FROM sales_orders", "FROM so2").replace("FROM customers", "FROM cu2")


def _cancelled(t):
    old = t.sales_orders.where(F.col("status") == "pending")
    return old, old.withColumn("status", F.lit("cancelled"))


@register("d1_dashboard_refreshed", _changed(PLAIN["d1_dashboard_kpis"]))
def d1_refreshed(t):
    """D1 from views of the tables as they are, refreshed by the changed rows alone."""
    back = t.customers.where(F.col("active") == 0)
    return V.dashboard(V.refreshed(V.sales_view(t.sales_orders), *_cancelled(t), V.sales_view, ("order_date",)),
                       V.refreshed(V.customers_view(t.customers), back, back.withColumn("active", F.lit(1)), V.customers_view),
                       V.products_view(t.products), V.production_view(t.production_orders), V.materials_view(t.raw_materials), AS_OF)


@register("d26_outstanding_refreshed", _changed(PLAIN["d26_customer_outstanding"]))
def d26_refreshed(t):
    """D26 from its view, refreshed by the changed orders alone."""
    return V.outstanding(V.refreshed(V.outstanding_view(t.sales_orders), *_cancelled(t), V.outstanding_view, ("customer_id",)))
