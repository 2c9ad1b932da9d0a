"""Registered 2J streaming jobs. Each runs its stream to the end of the
available data (``availableNow``) and returns what the sink holds; the oracle
is the batch twin's SQL (with one micro-batch nothing is late)."""

from __future__ import annotations

from millrace.plans.catalog import register
from millrace.plans.q_feeds import F1_SQL
from millrace.plans.q_rules import I9_SQL
from millrace.streaming import jobs as J

MS = "CAST(SUM(CAST({} AS DECIMAL(18,4))) AS DOUBLE)".format


@register("j1_stream_daily_sales", f"""
SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS orders, {MS('total_amount')} AS revenue
FROM sales_orders WHERE status <> 'cancelled' GROUP BY 1
""")
def j1(t):
    return J.run_daily_sales(t.spark, t.sf_dir, "1 day")


J2_SQL = I9_SQL + """,
pr AS (SELECT r.*, lag(r.balance) OVER (PARTITION BY r.material_id ORDER BY r.rn) AS lb FROM r),
al AS (SELECT pr.id, pr.material_id, pr.reason IS NULL AS accepted, pr.reason, CAST(pr.balance AS DOUBLE) AS balance,
              CASE WHEN pr.balance = 0 AND COALESCE(pr.lb, ev.x0) <> 0 THEN 'out'
                   WHEN pr.balance <= m.min_quantity AND m.min_quantity < COALESCE(pr.lb, ev.x0) THEN 'low' END AS alert
       FROM pr JOIN ev ON ev.id = pr.id LEFT JOIN raw_materials m ON m.id = pr.material_id)
"""


@register("j2_stream_material_ledger", J2_SQL + "SELECT * FROM al")
def j2(t):
    return J.run_material_ledger(t.spark, t.sf_dir, t.raw_materials, "reject")


@register("j3_stream_stock_alerts", J2_SQL + "SELECT id, material_id, balance, alert FROM al WHERE alert IS NOT NULL")
def j3(t):
    return J.stock_alerts(J.run_material_ledger(t.spark, t.sf_dir, t.raw_materials, "reject"))


@register("j4_stream_activity_feed", F1_SQL)
def j4(t):
    return J.run_activity_feed(t.spark, t.sf_dir, t, 12)


@register("j5_dedupe_status_events", "SELECT DISTINCT order_id, kind, status FROM order_events")
def j5(t):
    return J.run_dedupe(t.spark, t.sf_dir, "1 hour").select("order_id", "kind", "status")
