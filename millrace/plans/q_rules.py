"""Registered 2I business-rule jobs and their oracles.

Sequential rules (I3, I9, I11, I12) are checked against DuckDB ``WITH
RECURSIVE`` folds over ``row_number`` - an independent formulation of the
same rule, one event per recursion step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import numbering as G
from millrace.operators import rules as I
from millrace.operators.stored import store_changes, store_settings
from millrace.plans.catalog import register
from millrace.plans.q_filters import BATCH_SQL
from millrace.session import ensure_checkpoint_dir
from millrace.sources.stored import StoredTable
from millrace.sources.tables import load_table

MS = "CAST(SUM(CAST({} AS DECIMAL(18,4))) AS DOUBLE)".format
PRODUCED = "COALESCE(CASE WHEN quantity_produced <> 0 THEN quantity_produced END, quantity_planned)"

def _changes_sql(entity: str, table: str, changes: str, types: dict[str, str], carried: list[str], rejects: bool) -> str:
    """I1 one change after the other: a recursive fold per key (steps numbered by seq within the key)."""
    spec = I.CHANGE_SPECS[entity]
    keys = [spec["key"]] if isinstance(spec["key"], str) else spec["key"]
    auto, mode, defaults = keys == ["id"], spec["delete"], spec["insert_defaults"]
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    key = " || '/' || ".join(f"CAST({{0}}{k} AS VARCHAR)" for k in keys)
    keep = "FALSE" if not spec.get("protected") else f"r.k IN ({', '.join(map(lit, spec['protected']))})"
    top = f"(SELECT max(id) FROM {table})"
    numbered = f"CASE WHEN op = 'insert' THEN {top} + count(*) FILTER (op = 'insert') OVER (ORDER BY seq) ELSE id END AS id" if auto else ""
    source = f"(SELECT * REPLACE ({numbered}) FROM {changes})" if auto else changes
    why = (f"CASE WHEN e.op = 'insert' AND r.live THEN 'duplicate_key' WHEN e.op <> 'insert' AND NOT r.live THEN 'not_found' "
           f"WHEN e.op = 'delete' AND {keep} THEN 'protected' WHEN e.op = 'delete' AND {mode == 'none'} THEN 'not_allowed' END")
    cols = []
    for c, kind in types.items():
        default = defaults.get(c, 1 if c == "active" and mode == "soft" else None)
        ins = f"COALESCE(e.{c}, {lit(default)})" if c in carried else lit(default)
        if c in keys:
            cols.append(f"e.{c}")
            continue
        new = f"r.{c}" if c == "id" else f"CASE WHEN x.ok AND e.op = 'insert' THEN {ins} "
        if c != "id":
            if c in spec["updatable"] and c in carried:
                new += f"WHEN x.ok AND e.op = 'update' THEN e.{c} "
            if (mode, c) in (("soft", "active"), ("status", "status")):
                new += f"WHEN x.ok AND e.op = 'delete' THEN {lit(0 if c == 'active' else 'cancelled')} "
            new += f"ELSE r.{c} END"
        cols.append(f"CAST({new} AS {kind}) AS {c}")
    start = ", ".join(f"t.{c}" for c in types)
    body = f"""
WITH RECURSIVE ch AS (SELECT *, {key.format('')} AS k, row_number() OVER (PARTITION BY {key.format('')} ORDER BY seq) AS rn
                      FROM {source} s WHERE {key.format('')} IS NOT NULL),
r AS (
  SELECT d.k, CAST(0 AS BIGINT) AS rn, t.{keys[0]} IS NOT NULL AS live, CAST(NULL AS BIGINT) AS made, CAST(NULL AS VARCHAR) AS why, {start}
  FROM (SELECT DISTINCT k FROM ch) d LEFT JOIN {table} t ON {key.format('t.')} = d.k
  UNION ALL
  SELECT r.k, e.rn, CASE WHEN x.ok AND e.op = 'insert' THEN TRUE WHEN x.ok AND e.op = 'delete' AND {mode == 'hard'} THEN FALSE ELSE r.live END,
         CASE WHEN x.ok AND e.op = 'insert' THEN e.seq ELSE r.made END, x.why, {', '.join(cols)}
  FROM r JOIN ch e ON e.k = r.k AND e.rn = r.rn + 1
  CROSS JOIN LATERAL (SELECT {why} AS why, ({why}) IS NULL AS ok) x)
"""
    if rejects:
        shown = ", ".join(f"c.{k}" for k in keys)
        return body + f"""SELECT c.seq, {shown}, c.op, r.why AS reason FROM r JOIN ch c ON c.k = r.k AND c.rn = r.rn WHERE r.why IS NOT NULL
UNION ALL SELECT seq, {', '.join(keys)}, op, 'missing_key' FROM {source} s WHERE {key.format('')} IS NULL"""
    ids = f"""CASE WHEN f.made IS NOT NULL THEN {top} + (SELECT count(*) FROM r i JOIN ch c ON c.k = i.k AND c.rn = i.rn
              WHERE c.op = 'insert' AND i.why IS NULL AND c.seq <= f.made) ELSE f.id END AS id"""
    out = ", ".join(ids if c == "id" and not auto else f"f.{c}" for c in types)
    return body + f"""SELECT {out} FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY rn DESC) = 1) f WHERE f.live
UNION ALL SELECT {start} FROM {table} t WHERE {key.format('t.')} NOT IN (SELECT k FROM ch)"""


#: entity -> (table, its change feed, column types, columns that the feed carries)
I1_FEEDS = {
    "products": ("products", "product_changes", {
        "id": "BIGINT", "code": "VARCHAR", "name": "VARCHAR", "size_ml": "INTEGER", "unit": "VARCHAR", "price": "DOUBLE", "cost": "DOUBLE",
        "stock": "BIGINT", "min_stock": "BIGINT", "active": "INTEGER"}, ["name", "price"]),
    "raw_materials": ("raw_materials", "material_changes", {
        "id": "BIGINT", "code": "VARCHAR", "name": "VARCHAR", "unit": "VARCHAR", "quantity": "DOUBLE", "min_quantity": "DOUBLE",
        "cost_per_unit": "DOUBLE"}, ["name", "unit", "quantity", "min_quantity", "cost_per_unit"]),
    "expenses": ("expenses", "expense_changes", {
        "id": "BIGINT", "category": "VARCHAR", "amount": "DOUBLE", "expense_date": "DATE", "created_by": "BIGINT", "created_at": "TIMESTAMP"},
        ["category", "amount", "expense_date"]),
    "product_bom": ("(SELECT min(id) AS id, product_id, material_id, min(quantity_per_unit) AS quantity_per_unit FROM product_bom "
                    "GROUP BY product_id, material_id)", "bom_changes", {
        "id": "BIGINT", "product_id": "BIGINT", "material_id": "BIGINT", "quantity_per_unit": "DOUBLE"}, ["quantity_per_unit"]),
    "deliveries": ("deliveries", "delivery_changes", {
        "id": "BIGINT", "order_id": "BIGINT", "driver_name": "VARCHAR", "delivery_date": "DATE", "status": "VARCHAR",
        "created_at": "TIMESTAMP"}, ["status", "driver_name"]),
    "sales_orders": ("(SELECT id, customer_id, status, total_amount FROM sales_orders)", "order_status_changes", {
        "id": "BIGINT", "customer_id": "BIGINT", "status": "VARCHAR", "total_amount": "DOUBLE"}, ["status", "total_amount"]),
    "users": ("users", "user_changes", {
        "id": "INTEGER", "username": "VARCHAR", "name": "VARCHAR", "role": "VARCHAR", "active": "INTEGER"}, ["name", "role"]),
}


def _i1(entity: str, part: int):
    def run(t):
        current = getattr(t, entity)
        if entity == "product_bom":
            current = current.groupBy("product_id", "material_id").agg(
                F.min("id").alias("id"), F.min("quantity_per_unit").alias("quantity_per_unit")).select(
                "id", "product_id", "material_id", "quantity_per_unit")
        if entity == "sales_orders":
            current = current.select("id", "customer_id", "status", "total_amount")
        return I.apply_changes(current, getattr(t, I1_FEEDS[entity][1]), entity)[part]
    return run


for _entity, _feed in I1_FEEDS.items():
    _name = "i1_apply_changes" if _entity == "products" else f"i1_{_entity}_changes"
    register(f"{_name}_state", _changes_sql(_entity, *_feed, rejects=False))(_i1(_entity, 0))
    register(f"{_name}_rejects", _changes_sql(_entity, *_feed, rejects=True))(_i1(_entity, 1))


def _stored(t, name: str, keys: list[str]) -> StoredTable:
    return StoredTable(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/stored/{name}-{uuid.uuid4().hex}", keys, 16)


def _i1_stored(entity: str):
    """The table is stored, and the changes come in two batches, cut at the middle number."""
    def run(t):
        table = _stored(t, entity, [I.CHANGE_SPECS[entity]["key"]])
        table.load(0, getattr(t, entity))
        changes = getattr(t, I1_FEEDS[entity][1])
        middle = changes.agg(F.percentile_approx("seq", 0.5)).scalar()
        store_changes(table, 1, changes.where(F.col("seq") <= middle), entity)
        store_changes(table, 2, changes.where(F.col("seq") > middle), entity)
        return table.read()
    return run


for _entity in ("products", "expenses"):
    register(f"i1_stored_{_entity}", _changes_sql(_entity, *I1_FEEDS[_entity], rejects=False))(_i1_stored(_entity))


def _items_with_line_no(t):
    li = load_table(t.spark, t.sf_dir, "lineitem")
    return li.selectExpr("l_orderkey AS order_id", "l_partkey AS product_id", "CAST(l_quantity AS INT) AS quantity",
                         "l_extendedprice / l_quantity AS unit_price", "l_linenumber AS line_no")


@register("i2_validate_sales_orders", f"""
WITH it AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
                   l_extendedprice / l_quantity AS unit_price, l_linenumber AS line_no FROM lineitem),
tot AS (SELECT order_id, {MS('quantity * unit_price')} AS items_total, COUNT(*) AS lines FROM it GROUP BY order_id),
owed AS (SELECT customer_id, {MS('total_amount - paid_amount')} AS owed FROM sales_orders
         WHERE status NOT IN ('paid', 'cancelled', 'pending') GROUP BY customer_id),
li AS (SELECT it.*, CASE WHEN quantity IS NULL OR quantity <= 0 THEN 2 WHEN unit_price IS NULL OR unit_price <= 0 THEN 3
                          WHEN p.id IS NULL THEN 4 WHEN p.stock < quantity THEN 5 END AS r
       FROM it LEFT JOIN products p ON p.id = it.product_id),
fl AS (SELECT order_id, arg_min(r, line_no * 10 + r) AS lr FROM li WHERE r IS NOT NULL GROUP BY order_id),
h AS (SELECT so.id AS order_id, so.customer_id, so.order_date, COALESCE(so.discount, 0) AS disc, tot.items_total,
             tot.lines, c.credit_limit, owed.owed, fl.lr
      FROM sales_orders so LEFT JOIN tot ON tot.order_id = so.id LEFT JOIN customers c ON c.id = so.customer_id
      LEFT JOIN owed ON owed.customer_id = so.customer_id LEFT JOIN fl ON fl.order_id = so.id WHERE so.status = 'pending'),
r AS (SELECT *, COALESCE(items_total, 0) - disc AS new_total,
             COALESCE(CASE WHEN COALESCE(customer_id, 0) = 0 OR order_date IS NULL OR COALESCE(lines, 0) = 0 THEN 0
                           WHEN credit_limit > 0 AND COALESCE(owed, 0) + (COALESCE(items_total, 0) - disc) > credit_limit
                           THEN 1 END, lr) AS rule FROM h)
SELECT order_id, customer_id, new_total,
       ['missing_fields', 'credit_limit', 'bad_quantity', 'bad_price', 'unknown_product', 'insufficient_stock'][rule + 1]
         AS reason
FROM r
""")
def i2(t):
    """The pending orders are the new ones; all others that are open owe already."""
    new = F.col("status") == "pending"
    return I.validate_sales_orders(t.sales_orders.where(new), _items_with_line_no(t), t.customers, t.products,
                                   t.sales_orders.where(~new))


@register("i3_credit_replay", """
WITH RECURSIVE ev AS (
  SELECT so.id, so.customer_id, CAST(COALESCE(so.total_amount, 0) AS DECIMAL(38,4)) AS t,
         CAST(c.credit_limit AS DECIMAL(18,4)) AS lim,
         row_number() OVER (PARTITION BY so.customer_id ORDER BY so.created_at, so.id) AS rn
  FROM sales_orders so LEFT JOIN customers c ON c.id = so.customer_id),
r AS (
  SELECT id, customer_id, rn, ok AS accepted, CASE WHEN ok THEN t ELSE CAST(0 AS DECIMAL(38,4)) END AS owed
  FROM (SELECT *, (lim IS NULL OR lim <= 0 OR t <= lim) AS ok FROM ev WHERE rn = 1) a
  UNION ALL
  SELECT e.id, e.customer_id, e.rn, (e.lim IS NULL OR e.lim <= 0 OR r.owed + e.t <= e.lim),
         CASE WHEN (e.lim IS NULL OR e.lim <= 0 OR r.owed + e.t <= e.lim) THEN r.owed + e.t ELSE r.owed END
  FROM r JOIN ev e ON e.customer_id = r.customer_id AND e.rn = r.rn + 1)
SELECT id, customer_id, accepted, CAST(owed AS DOUBLE) AS outstanding_after FROM r
""")
def i3(t):
    return I.credit_replay(t.sales_orders, t.customers)


@register("i4_price_orders", f"""
SELECT so.id AS order_id, COALESCE(so.discount, 0) AS discount, t.items_total, t.line_count,
       COALESCE(t.items_total, 0) - COALESCE(so.discount, 0) AS total
FROM sales_orders so LEFT JOIN (SELECT order_id, {MS('quantity * unit_price')} AS items_total, COUNT(*) AS line_count
                                FROM sales_items GROUP BY order_id) t ON t.order_id = so.id
""")
def i4(t):
    return I.price_orders(t.sales_items, t.sales_orders)


I5_SQL = f"""
WITH pob AS ({BATCH_SQL}),
done AS (SELECT id AS production_order_id, product_id, {PRODUCED} AS produced, batch_number, created_at
         FROM pob WHERE status = 'completed')
SELECT d.production_order_id, d.product_id, b.material_id, m.name AS material_name, d.produced,
       b.quantity_per_unit * d.produced AS need, b.quantity_per_unit * d.produced * m.cost_per_unit AS material_cost,
       greatest(b.quantity_per_unit * d.produced - m.quantity, 0.0) AS shortage,
       'ผลิต Batch: ' || COALESCE(d.batch_number, 'N/A') || ' x' || CAST(d.produced AS VARCHAR) AS note, d.created_at
FROM done d JOIN product_bom b ON b.product_id = d.product_id LEFT JOIN raw_materials m ON m.id = b.material_id
"""


@register("i5_bom_requirements", I5_SQL)
def i5(t):
    return I.bom_requirements(G.assign_batch_numbers(t.production_orders), t.product_bom, t.raw_materials)


@register("i5_material_needs", f"""
SELECT material_id, {MS('need')} AS need, {MS('material_cost')} AS material_cost FROM ({I5_SQL}) x GROUP BY material_id
""")
def i5_needs(t):
    return I.material_needs(I.bom_requirements(G.assign_batch_numbers(t.production_orders), t.product_bom,
                                               t.raw_materials))


I6_SQL = f"""
SELECT product_id, CAST(SUM({PRODUCED}) AS BIGINT) AS produced FROM production_orders
WHERE status = 'completed' GROUP BY product_id
"""


@register("i6_production_stock_moves", I6_SQL)
def i6(t):
    return I.production_stock_moves(t.production_orders)


PRODUCTION_SQL = """
WITH e AS (SELECT v.*, p.product_id, CASE WHEN v.quantity_produced <> 0 THEN v.quantity_produced ELSE p.quantity_planned END AS made
           FROM production_events v, production_orders p WHERE p.id = v.order_id)
"""


@register("i6_production_replay_state", PRODUCTION_SQL + """,
l AS (SELECT order_id, last(status ORDER BY ts, seq) AS status, min(ts) FILTER (status = 'in_progress') AS started_at,
             max(ts) FILTER (status = 'completed') AS completed_at, last(made ORDER BY ts, seq) FILTER (status = 'completed') AS made
      FROM e GROUP BY order_id)
SELECT p.* REPLACE (ifnull(l.status, p.status) AS status, ifnull(l.made, p.quantity_produced) AS quantity_produced), l.started_at, l.completed_at
FROM production_orders p LEFT JOIN l ON l.order_id = p.id
""")
def i6_state(t):
    return I.production_replay(t.production_orders, t.production_events)[0]


@register("i6_production_replay_moves", PRODUCTION_SQL + "SELECT order_id, product_id, made AS quantity, ts, seq FROM e WHERE status = 'completed'")
def i6_moves(t):
    return I.production_replay(t.production_orders, t.production_events)[1]


@register("i7_po_receipts_replay", f"""
WITH n AS (SELECT id, count(*) AS k FROM status_events WHERE status = 'received' GROUP BY id)
SELECT material_id, CAST(SUM(CAST(quantity AS DECIMAL(18,4)) * k) AS DOUBLE) AS received
FROM purchase_items, n WHERE n.id = po_id GROUP BY material_id
""")
def i7_replay(t):
    return I.po_receipts(t.purchase_orders, t.purchase_items, t.status_events)[1]


@register("i14_return_approvals_replay", """
SELECT product_id, CAST(sum(r.quantity) AS BIGINT) AS returned FROM status_events s, returns r
WHERE s.status = 'approved' AND r.id = s.id AND product_id IS NOT NULL GROUP BY product_id
""")
def i14_replay(t):
    return I.return_restock(t.returns, t.status_events)


@register("i7_po_receipt_logs", """
SELECT pi.po_id, pi.material_id, 'in' AS type, pi.quantity, 'รับจาก PO: ' || po.po_number AS note, po.created_by
FROM purchase_items pi JOIN purchase_orders po ON po.id = pi.po_id WHERE po.status = 'received'
""")
def i7_logs(t):
    return I.po_receipts(t.purchase_orders, t.purchase_items)[0]


@register("i7_po_receipts", f"""
SELECT pi.material_id, {MS('pi.quantity')} AS received
FROM purchase_items pi JOIN purchase_orders po ON po.id = pi.po_id WHERE po.status = 'received' GROUP BY pi.material_id
""")
def i7(t):
    return I.po_receipts(t.purchase_orders, t.purchase_items)[1]


@register("i8_material_ledger", """
WITH x AS (SELECT ml.*, CAST(COALESCE(m.quantity, 0) AS DECIMAL(18,4)) AS x0,
                  CAST(CASE WHEN ml.type = 'in' THEN ml.quantity ELSE -ml.quantity END AS DECIMAL(18,4)) AS d,
                  ml.type <> 'in' AS c
           FROM material_logs ml LEFT JOIN raw_materials m ON m.id = ml.material_id),
y AS (SELECT *, SUM(d) OVER (PARTITION BY material_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS s FROM x),
z AS (SELECT *, MAX(CASE WHEN c THEN -s END) OVER (PARTITION BY material_id ORDER BY created_at, id
                                                   ROWS UNBOUNDED PRECEDING) AS m FROM y)
SELECT id, material_id, type, quantity, note, created_by, created_at,
       CAST(s + greatest(x0, COALESCE(m, x0)) AS DOUBLE) AS balance
FROM z
""")
def i8(t):
    return I.material_ledger(t.raw_materials, t.material_logs)


I9_SQL = """
WITH RECURSIVE ev AS (
  SELECT ml.id, ml.material_id, ml.type, ml.quantity, m.id IS NOT NULL AS known,
         CASE WHEN m.id IS NOT NULL THEN CAST(COALESCE(m.quantity, 0) AS DECIMAL(38,4)) END AS x0,
         CAST(ml.quantity AS DECIMAL(38,4)) AS q,
         row_number() OVER (PARTITION BY ml.material_id ORDER BY ml.created_at, ml.id) AS rn
  FROM material_logs ml LEFT JOIN raw_materials m ON m.id = ml.material_id),
r AS (
  SELECT id, material_id, rn, reason, CASE WHEN reason IS NULL THEN nb ELSE x0 END AS balance
  FROM (SELECT *, CASE WHEN type = 'in' THEN x0 + q ELSE x0 - q END AS nb,
               CASE WHEN quantity IS NULL OR quantity <= 0 THEN 'bad_quantity'
                    WHEN NOT known THEN 'unknown_material'
                    WHEN (CASE WHEN type = 'in' THEN x0 + q ELSE x0 - q END) < 0
                    THEN 'insufficient_stock' END AS reason
        FROM ev WHERE rn = 1) a
  UNION ALL
  SELECT e.id, e.material_id, e.rn,
         CASE WHEN e.quantity IS NULL OR e.quantity <= 0 THEN 'bad_quantity'
              WHEN NOT e.known THEN 'unknown_material'
              WHEN (CASE WHEN e.type = 'in' THEN r.balance + e.q ELSE r.balance - e.q END) < 0
              THEN 'insufficient_stock' END,
         CASE WHEN e.quantity IS NULL OR e.quantity <= 0 THEN r.balance
              WHEN (CASE WHEN e.type = 'in' THEN r.balance + e.q ELSE r.balance - e.q END) < 0
              THEN r.balance
              ELSE (CASE WHEN e.type = 'in' THEN r.balance + e.q ELSE r.balance - e.q END) END
  FROM r JOIN ev e ON e.material_id = r.material_id AND e.rn = r.rn + 1)
"""


@register("i9_material_adjust_replay", I9_SQL + """
SELECT id, material_id, reason IS NULL AS accepted, reason, CAST(balance AS DOUBLE) AS balance FROM r
""")
def i9(t):
    return I.material_adjust_replay(t.raw_materials, t.material_logs)


@register("i9_material_final_stock", I9_SQL + """
SELECT material_id, CAST(arg_max(balance, id) AS DOUBLE) AS balance FROM r GROUP BY material_id
""")
def i9_final(t):
    return I.final_state(I.material_adjust_replay(t.raw_materials, t.material_logs), "material_id", "id", "balance")


I10_SQL = """
WITH ev AS (SELECT e.seq, e.order_id, e.status, e.ts, so.status AS s0 FROM order_events e
            JOIN sales_orders so ON so.id = e.order_id WHERE e.kind = 'set_status'),
pv AS (SELECT *, COALESCE(lag(status) OVER (PARTITION BY order_id ORDER BY ts, seq), s0) AS prev FROM ev),
n AS (SELECT order_id, COUNT(*) AS times FROM pv WHERE status = 'delivered' AND prev NOT IN ('delivered', 'paid')
      GROUP BY order_id)
SELECT si.product_id, CAST(SUM(si.quantity * n.times) AS BIGINT) AS delivered
FROM sales_items si JOIN n ON n.order_id = si.order_id GROUP BY si.product_id
"""


@register("i10_sales_stock_moves", I10_SQL)
def i10(t):
    return I.sales_stock_moves(t.order_events, t.sales_orders, t.sales_items)


I11_SQL = """
WITH RECURSIVE ev AS (
  SELECT pa.seq, pa.order_id, pa.amount, CAST(pa.amount AS DECIMAL(38,4)) AS a,
         CAST(so.total_amount AS DECIMAL(38,4)) AS total, so.status AS s0,
         row_number() OVER (PARTITION BY pa.order_id ORDER BY pa.seq) AS rn
  FROM payment_attempts pa JOIN sales_orders so ON so.id = pa.order_id),
r AS (
  SELECT seq, order_id, rn, ok AS accepted, CASE WHEN ok THEN a ELSE CAST(0 AS DECIMAL(38,4)) END AS paid,
         CASE WHEN ok THEN (CASE WHEN a >= total THEN 'paid' ELSE 'confirmed' END) ELSE s0 END AS status
  FROM (SELECT *, (amount IS NOT NULL AND amount <> 0 AND a <= total) AS ok FROM ev WHERE rn = 1) x
  UNION ALL
  SELECT e.seq, e.order_id, e.rn, x.ok, CASE WHEN x.ok THEN r.paid + e.a ELSE r.paid END,
         CASE WHEN x.ok THEN (CASE WHEN r.paid + e.a >= e.total THEN 'paid' ELSE 'confirmed' END) ELSE r.status END
  FROM r JOIN ev e ON e.order_id = r.order_id AND e.rn = r.rn + 1
  CROSS JOIN LATERAL (SELECT (e.amount IS NOT NULL AND e.amount <> 0 AND e.a <= e.total - r.paid) AS ok) x)
SELECT seq, order_id, accepted, CAST(paid AS DOUBLE) AS paid, status FROM r
"""


@register("i11_payments_replay", I11_SQL)
def i11(t):
    return I.payments_replay(t.sales_orders, t.payment_attempts)


I12_SQL = """
WITH RECURSIVE ev AS (
  SELECT e.*, CAST(e.amount AS DECIMAL(38,4)) AS a,
         row_number() OVER (PARTITION BY e.order_id ORDER BY e.ts, e.seq) AS rn
  FROM order_events e WHERE e.order_id IN (SELECT id FROM sales_orders)),
init AS (
  SELECT so.id AS order_id, so.status, CAST(so.paid_amount AS DECIMAL(38,4)) AS paid,
         CAST(so.total_amount AS DECIMAL(38,4)) AS total,
         EXISTS (SELECT 1 FROM deliveries d WHERE d.order_id = so.id) AS has_del
  FROM sales_orders so WHERE so.id IN (SELECT order_id FROM ev)),
r AS (
  SELECT order_id, 0 AS rn, status, paid, total, has_del, 0 AS moves, 0 AS rejected FROM init
  UNION ALL
  SELECT r.order_id, e.rn,
    CASE WHEN e.kind = 'set_status' THEN e.status
         WHEN e.kind = 'cancel' THEN 'cancelled'
         WHEN x.pay_ok THEN CASE WHEN r.paid + e.a >= r.total THEN 'paid' ELSE 'confirmed' END
         WHEN e.kind = 'delivery_created' AND NOT r.has_del AND r.status = 'pending' THEN 'confirmed'
         WHEN e.kind = 'delivery_status' AND r.has_del AND e.status = 'delivered'
              AND r.status NOT IN ('delivered', 'paid') THEN 'delivered'
         ELSE r.status END,
    CASE WHEN x.pay_ok THEN r.paid + e.a ELSE r.paid END,
    r.total,
    r.has_del OR e.kind = 'delivery_created',
    r.moves + CASE WHEN e.kind IN ('set_status', 'delivery_status') AND e.status = 'delivered'
                        AND r.status NOT IN ('delivered', 'paid') AND (e.kind = 'set_status' OR r.has_del)
                   THEN 1 ELSE 0 END,
    r.rejected + CASE WHEN e.kind = 'payment' AND NOT x.pay_ok THEN 1
                      WHEN e.kind = 'delivery_created' AND r.has_del THEN 1
                      WHEN e.kind = 'delivery_status' AND NOT r.has_del THEN 1 ELSE 0 END
  FROM r JOIN ev e ON e.order_id = r.order_id AND e.rn = r.rn + 1
  CROSS JOIN LATERAL (SELECT (e.kind = 'payment' AND e.amount IS NOT NULL AND e.amount <> 0
                              AND e.a <= r.total - r.paid) AS pay_ok) x)
SELECT order_id, arg_max(status, rn) AS status, CAST(arg_max(paid, rn) AS DOUBLE) AS paid, CAST(arg_max(moves, rn) AS BIGINT) AS stock_moves,
       CAST(arg_max(rejected, rn) AS BIGINT) AS rejected, CAST(max(rn) AS BIGINT) AS events
FROM r GROUP BY order_id
"""


@register("i12_order_lifecycle_replay", I12_SQL)
def i12(t):
    return I.order_lifecycle_replay(t.sales_orders, t.order_events, t.deliveries)


@register("i13_customer_balances", f"""
SELECT c.id AS customer_id, c.type,
       c.balance + CASE WHEN c.type <> 'retail' THEN COALESCE(p.pay, 0) ELSE 0 END AS balance
FROM customers c LEFT JOIN (SELECT so.customer_id, {MS('pm.amount')} AS pay FROM payments pm
                            JOIN sales_orders so ON so.id = pm.order_id GROUP BY so.customer_id) p
  ON p.customer_id = c.id
""")
def i13(t):
    return I.customer_balances(t.payments, t.sales_orders, t.customers)


I14_SQL = """
SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS returned FROM returns
WHERE status = 'approved' AND product_id IS NOT NULL GROUP BY product_id
"""


@register("i14_return_restock", I14_SQL)
def i14(t):
    return I.return_restock(t.returns)


@register("i15_product_stock_rebuild", f"""
WITH pr AS ({I6_SQL}), dl AS ({I10_SQL}), rt AS ({I14_SQL})
SELECT p.id AS product_id, COALESCE(pr.produced, 0) AS produced, COALESCE(dl.delivered, 0) AS delivered,
       COALESCE(rt.returned, 0) AS returned,
       CAST(COALESCE(pr.produced, 0) - COALESCE(dl.delivered, 0) + COALESCE(rt.returned, 0) AS BIGINT) AS rebuilt_stock,
       p.stock AS stored_stock,
       CAST(p.stock - (COALESCE(pr.produced, 0) - COALESCE(dl.delivered, 0) + COALESCE(rt.returned, 0)) AS BIGINT)
         AS difference
FROM products p LEFT JOIN pr ON pr.product_id = p.id LEFT JOIN dl ON dl.product_id = p.id
LEFT JOIN rt ON rt.product_id = p.id
""")
def i15(t):
    return I.product_stock_rebuild(t.products, I.production_stock_moves(t.production_orders),
                                   I.sales_stock_moves(t.order_events, t.sales_orders, t.sales_items),
                                   I.return_restock(t.returns))


@register("i16_equipment_rollup", """
SELECT e.id, e.code, e.name, e.status,
       CASE WHEN l.equipment_id IS NOT NULL THEN l.pd END AS last_maintenance,
       CASE WHEN l.equipment_id IS NOT NULL THEN l.nd ELSE e.next_maintenance END AS next_maintenance
FROM equipment e LEFT JOIN (SELECT equipment_id, arg_max(performed_date, id) AS pd, arg_max(next_due, id) AS nd
                            FROM maintenance_logs GROUP BY equipment_id) l ON l.equipment_id = e.id
""")
def i16(t):
    return I.equipment_rollup(t.equipment, t.maintenance_logs)


@register("i17_qc_normalize", """
SELECT id, production_order_id, CASE WHEN ph <> 0 THEN ph END AS ph, CASE WHEN tds <> 0 THEN tds END AS tds,
       CASE WHEN turbidity <> 0 THEN turbidity END AS turbidity, COALESCE(NULLIF(result, ''), 'pending') AS result,
       test_date, created_by, created_at, 'ปกติ' AS odor, 'ปกติ' AS taste
FROM water_quality_tests WHERE test_date IS NOT NULL
""")
def i17(t):
    return I.qc_normalize(t.water_quality_tests)[0]


def _jsnum(x: str) -> str:
    return f"rtrim(rtrim(CAST(CAST({x} AS DECIMAL(38,10)) AS VARCHAR), '0'), '.')"


@register("i18_audit_events", f"""
WITH pob AS ({BATCH_SQL}),
rows AS (
SELECT CAST(created_by AS BIGINT) AS user_id, 'create' AS action, 'production' AS entity, id AS entity_id,
       'Batch: ' || COALESCE(batch_number, 'undefined') AS details, created_at FROM pob
UNION ALL SELECT created_by, 'create', 'qc', id, 'QC test batch undefined', created_at FROM water_quality_tests
UNION ALL SELECT created_by, 'create', 'expense', id, category || ': ' || {_jsnum('amount')} || ' บาท', created_at
          FROM expenses
UNION ALL SELECT created_by, 'create', 'purchase_order', id, 'PO: ' || po_number, created_at FROM purchase_orders
UNION ALL SELECT created_by, 'create', 'maintenance', id, 'ซ่อมบำรุง: ' || maintenance_type, created_at
          FROM maintenance_logs
UNION ALL SELECT created_by, 'create', 'return', id, 'คืนสินค้า: ' || {_jsnum('quantity')} || ' ชิ้น', created_at
          FROM returns)
SELECT rows.*, (SELECT name FROM users WHERE users.id = user_id) AS user_name FROM rows
""")
def i18(t):
    return I.audit_events(G.assign_batch_numbers(t.production_orders), t.water_quality_tests, t.expenses,
                          t.purchase_orders, t.maintenance_logs, t.returns, t.users)


SETTINGS_SQL = """
SELECT key, arg_max(value, seq) AS value, arg_max(updated_at, seq) AS updated_at FROM app_settings_log GROUP BY key
"""


@register("i19_settings_upsert", SETTINGS_SQL)
def i19(t):
    return I.settings_upsert(None, t.app_settings_log)


@register("i19_stored_settings", SETTINGS_SQL)
def i19_stored(t):
    log = t.app_settings_log
    table = _stored(t, "settings", ["key"])
    middle = log.agg(F.percentile_approx("seq", 0.5)).scalar()
    table.load(0, I.settings_upsert(None, log.where(F.col("seq") <= middle)))
    store_settings(table, 1, log.where(F.col("seq") > middle))
    return table.read()


@register("a6_settings_map", f"""
SELECT array_to_string(list_sort(map_keys(m)), ',') AS key_list, m['view'] AS key0_value
FROM (SELECT map_from_entries(list(struct_pack(k := key, v := value))) AS m FROM ({SETTINGS_SQL}) s) x
""")
def a6(t):
    m = I.settings_map(I.settings_upsert(None, t.app_settings_log))
    return m.select(F.concat_ws(",", F.array_sort(F.map_keys("settings"))).alias("key_list"),
                    F.col("settings")["view"].alias("key0_value"))


@register("i20_validate_deposits", """
SELECT *, CASE WHEN customer_id IS NULL OR customer_id = 0 THEN 'missing_customer_id'
               WHEN transaction_date IS NULL THEN 'missing_transaction_date' END AS reason
FROM container_deposits
""")
def i20(t):
    return I.validate_inputs(t.container_deposits, "deposit")


@register("i20_validate_expenses", """
SELECT *, CASE WHEN category IS NULL OR category = '' THEN 'missing_category'
               WHEN amount IS NULL OR amount = 0 THEN 'missing_amount'
               WHEN expense_date IS NULL THEN 'missing_expense_date'
               WHEN amount <= 0 THEN 'non_positive_amount' END AS reason
FROM expenses
""")
def i20e(t):
    return I.validate_inputs(t.expenses, "expense")


@register("i20_validate_deliveries", """
SELECT d.*, COALESCE(CASE WHEN d.order_id IS NULL OR d.order_id = 0 THEN 'missing_order_id' END,
                     CASE WHEN d.id > f.first THEN 'duplicate_order_id' END) AS reason
FROM deliveries d LEFT JOIN (SELECT order_id, min(id) AS first FROM deliveries GROUP BY order_id) f
  ON f.order_id = d.order_id
""")
def i20d(t):
    return I.validate_inputs(t.deliveries, "delivery", unique=["order_id"])


@register("i20_validate_bom", """
SELECT b.*, COALESCE(CASE WHEN b.product_id IS NULL OR b.product_id = 0 THEN 'missing_product_id'
                          WHEN b.material_id IS NULL OR b.material_id = 0 THEN 'missing_material_id'
                          WHEN b.quantity_per_unit IS NULL OR b.quantity_per_unit = 0 THEN 'missing_quantity_per_unit' END,
                     CASE WHEN b.id > f.first THEN 'duplicate_product_id_material_id' END) AS reason
FROM product_bom b LEFT JOIN (SELECT product_id, material_id, min(id) AS first FROM product_bom
                              GROUP BY product_id, material_id) f
  ON f.product_id = b.product_id AND f.material_id = b.material_id
""")
def i20b(t):
    return I.validate_inputs(t.product_bom, "bom", unique=["product_id", "material_id"])


@register("i12_order_lifecycle_scan", I12_SQL)
def i12_scan(t):
    """I12 by the block scan, its only form."""
    return I.order_lifecycle_replay(t.sales_orders, t.order_events, t.deliveries)


@register("i9_material_adjust_speculative", I9_SQL + """
SELECT id, material_id, reason IS NULL AS accepted, reason, CAST(balance AS DOUBLE) AS balance FROM r
""")
def i9_spec(t):
    """I9 by running sums and repair, its only form."""
    return I.material_adjust_replay(t.raw_materials, t.material_logs)


@register("i11_payments_speculative", I11_SQL)
def i11_spec(t):
    """I11 by running sums and repair, its only form."""
    return I.payments_replay(t.sales_orders, t.payment_attempts)


def _validation_sql(table: str, checks: list[tuple[str, str]], name: str = "reason") -> str:
    """Oracle for ``validate_inputs``: (column, 'text'|'number'|'date') in rule order."""
    whens = []
    for col, kind in checks:
        miss = {"text": f"{col} IS NULL OR {col} = ''", "number": f"{col} IS NULL OR {col} = 0",
                "date": f"{col} IS NULL"}[kind]
        whens.append(f"WHEN {miss} THEN 'missing_{col}'")
    return f"SELECT *, CASE {' '.join(whens)} END AS {name} FROM {table}"


@register("i20_validate_returns", _validation_sql(
    "returns", [("product_id", "number"), ("quantity", "number"), ("reason", "text"), ("return_date", "date")],
    "invalid_reason"))
def i20r(t):
    return I.validate_inputs(t.returns, "return")


@register("i20_validate_maintenance", _validation_sql(
    "maintenance_logs", [("equipment_id", "number"), ("maintenance_type", "text"), ("performed_date", "date")]))
def i20m(t):
    return I.validate_inputs(t.maintenance_logs, "maintenance")


@register("i20_validate_payments", _validation_sql(
    "payments", [("order_id", "number"), ("amount", "number"), ("payment_date", "date")]))
def i20p(t):
    return I.validate_inputs(t.payments, "payment")


@register("i20_validate_routes", _validation_sql("delivery_routes", [("route_name", "text"), ("delivery_date", "date")]))
def i20rt(t):
    return I.validate_inputs(t.delivery_routes, "route")


def _i20(kind: str, table: str):
    def run(t):
        return I.validate_inputs(getattr(t, table), kind)
    return run


for _kind, _table, _checks in [
        ("material", "raw_materials", [("code", "text"), ("name", "text"), ("unit", "text")]),
        ("product", "products", [("code", "text"), ("name", "text")]),
        ("production", "production_orders", [("product_id", "number"), ("quantity_planned", "number")]),
        ("customer", "customers", [("code", "text"), ("name", "text")]), ("user", "users", [("username", "text"), ("name", "text")]),
        ("supplier", "suppliers", [("code", "text"), ("name", "text")]),
        ("purchase_order", "purchase_orders", [("supplier_id", "number"), ("order_date", "date")]),
        ("equipment", "equipment", [("code", "text"), ("name", "text")])]:
    register(f"i20_validate_{_kind}_inserts", _validation_sql(_table, _checks))(_i20(_kind, _table))
