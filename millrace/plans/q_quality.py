"""Registered 2L data-quality checks and their oracles (generated from the same rule lists)."""

from __future__ import annotations

from millrace.operators import numbering as G
from millrace.operators import quality as L
from millrace.operators import rules as I
from millrace.plans.catalog import register
from millrace.plans.q_filters import BATCH_SQL
from millrace.plans.q_rules import SETTINGS_SQL
from millrace.sources.bindings import binding_columns

MS = "CAST(SUM(CAST({} AS DECIMAL(18,4))) AS DOUBLE)".format

_FK_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}.{k}' AS fk, '{p}' AS parent, COUNT(*) AS orphan_rows "
    f"FROM {c} x WHERE x.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.id = x.{k})"
    for c, k, p in L.FOREIGN_KEYS)


@register("l1_fk_orphans", _FK_SQL)
def l1(t):
    return L.fk_orphans(t)


_UQ_SQL = "\nUNION ALL\n".join(
    f"SELECT '{tb}({','.join(cols)})' AS constraint, "
    f"concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}) AS key, COUNT(*) AS n "
    f"FROM {tb} GROUP BY {', '.join(cols)} HAVING COUNT(*) > 1"
    for tb, cols in L.UNIQUE_KEYS)


@register("l2_unique_violations", _UQ_SQL + f"""
UNION ALL
SELECT 'app_settings(key)', key, COUNT(*) FROM ({SETTINGS_SQL}) s GROUP BY key HAVING COUNT(*) > 1
""")
def l2(t):
    return L.unique_violations(t, I.settings_upsert(None, t.app_settings_log))


_NN_SQL = "\nUNION ALL\n".join(
    f"SELECT '{tb}' AS \"table\", '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {tb}"
    for tb, cols in L.REQUIRED.items() for c in cols if c in binding_columns(tb))


@register("l3_required_nulls", f"SELECT * FROM ({_NN_SQL}) x WHERE nulls > 0")
def l3(t):
    return L.required_nulls(t)


@register("l4_reconcile_totals", f"""
WITH it AS (SELECT order_id, {MS('subtotal')} AS items FROM sales_items GROUP BY order_id),
pp AS (SELECT order_id, {MS('amount')} AS paid FROM payments GROUP BY order_id),
oo AS (SELECT so.id, so.total_amount, so.paid_amount, so.discount, it.items, pp.paid FROM sales_orders so
       LEFT JOIN it ON it.order_id = so.id LEFT JOIN pp ON pp.order_id = so.id),
x AS (
  SELECT 'order_total' AS "check", id, total_amount AS stored, COALESCE(items, 0) - COALESCE(discount, 0) AS computed
  FROM oo
  UNION ALL SELECT 'paid_amount', id, paid_amount, COALESCE(paid, 0) FROM oo
  UNION ALL SELECT 'route_total_orders', dr.id, CAST(dr.total_orders AS DOUBLE),
                   CAST((SELECT COUNT(*) FROM delivery_route_orders d WHERE d.route_id = dr.id) AS DOUBLE)
            FROM delivery_routes dr)
SELECT * FROM x WHERE abs(stored - computed) > 0.005
""")
def l4(t):
    return L.reconcile_totals(t.sales_orders, t.sales_items, t.payments, t.delivery_routes, t.delivery_route_orders)


@register("l5_duplicate_batches", f"""
SELECT batch_number, COUNT(*) AS n, min(id) AS first_id, max(id) AS last_id FROM ({BATCH_SQL}) b
WHERE batch_number IS NOT NULL GROUP BY batch_number HAVING COUNT(*) > 1
""")
def l5(t):
    return L.duplicate_batches(G.assign_batch_numbers(t.production_orders))
