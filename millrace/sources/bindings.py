"""Bindings: the factory tables expressed as projections of the driver tables.

Each binding maps one driver table onto one factory table (users from nation,
products from part, sales orders from orders, ...). The select expressions are
plain SQL that Spark and DuckDB both accept, so one text serves the Spark
``selectExpr`` and the DuckDB oracle CTE. Which row is a payment, a delivery or
a QC test follows from a natural attribute (order status, priority, event type),
and child keys are real key columns, so every table grows with the data; modulo
expressions only spread *attribute values* (a size, a status) over rows.

Three bindings fan a row out over a short literal list (BOM lines, two
payments per order, two payment attempts); on Spark that is ``explode`` of a
literal array (a Generate node, no join). ``purchase_orders`` takes its supplier
from the order's lines. ``delivery_route_orders`` needs a per-route sequence
number; it uses the two-level running count so that one route never has to sit
in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.scan import running_count
from millrace.sources.tables import load_table

_CREATED_AT = "o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND AS created_at"
_PAID_FULL = "o_orderstatus = 'F'"
_OPS = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op"
_PO_STATUS = ("CASE o_orderkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' WHEN 2 THEN 'ordered' "
              "WHEN 3 THEN 'cancelled' ELSE 'received' END AS status")


@dataclass(frozen=True)
class Binding:
    source: str
    exprs: tuple[str, ...]
    where: str | None = None
    oracle: str | None = None  # full SELECT when the binding is not a plain projection
    tables: tuple[str, ...] = field(default=())

    def sql(self) -> str:
        if self.oracle:
            return self.oracle
        q = f"SELECT {', '.join(self.exprs)} FROM {self.source}"
        return q + (f" WHERE {self.where}" if self.where else "")


BINDINGS: dict[str, Binding] = {
    "users": Binding("nation", (
        "n_nationkey AS id", "lower(n_name) AS username", "n_name AS name",
        "CASE n_nationkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'manager' ELSE 'staff' END AS role",
        "CASE WHEN n_nationkey % 8 = 7 THEN 0 ELSE 1 END AS active",
    )),
    "products": Binding("part", (
        "p_partkey AS id", "concat('P', lpad(CAST(p_partkey AS STRING), 7, '0')) AS code", "p_name AS name",
        "CASE p_partkey % 6 WHEN 0 THEN 350 WHEN 1 THEN 600 WHEN 2 THEN 1500 WHEN 3 THEN 5000 "
        "WHEN 4 THEN 19000 ELSE 0 END AS size_ml",
        "CASE WHEN p_partkey % 6 = 4 THEN 'ถัง' ELSE 'ขวด' END AS unit",
        "p_retailprice AS price", "p_retailprice * 0.75 AS cost",
        "(p_partkey * 37) % 200 - CASE WHEN p_partkey % 97 = 5 THEN 200 ELSE 0 END AS stock",
        "20 + p_partkey % 40 AS min_stock",
        "CASE WHEN p_partkey % 50 = 7 THEN 0 ELSE 1 END AS active",
    )),
    "raw_materials": Binding("part", (
        "p_partkey AS id", "concat('M', lpad(CAST(p_partkey AS STRING), 9, '0')) AS code", "p_name AS name",
        "'kg' AS unit", "CAST((p_partkey * 53) % 500 AS DOUBLE) AS quantity",
        "CAST(40 + p_partkey % 80 AS DOUBLE) AS min_quantity", "p_size * CAST(1.25 AS DOUBLE) AS cost_per_unit",
    )),
    "product_bom": Binding("part", (), oracle=(
        "SELECT p_partkey * 3 + m.k AS id, p_partkey AS product_id, CASE m.k WHEN 0 THEN p_partkey WHEN 1 THEN "
        "CAST(p_size AS BIGINT) ELSE CAST(floor(p_partkey / 2.0) AS BIGINT) END AS material_id, "
        "CAST(m.q AS DOUBLE) AS quantity_per_unit FROM part CROSS JOIN "
        "(SELECT 1 AS q, 0 AS k UNION ALL SELECT 2, 1 UNION ALL SELECT 1, 2) m"),
        tables=("part",)),
    "customers": Binding("customer", (
        "c_custkey AS id", "concat('C', lpad(CAST(c_custkey AS STRING), 7, '0')) AS code", "c_name AS name",
        "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('08', lpad(CAST(c_custkey AS STRING), 8, '0')) END AS phone",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'wholesale' WHEN 'FURNITURE' THEN 'corporate' "
        "WHEN 'HOUSEHOLD' THEN 'distributor' ELSE 'retail' END AS type",
        "CASE WHEN c_acctbal > 0 THEN c_acctbal * 100 ELSE 0 END AS credit_limit",
        "CAST(0 AS DOUBLE) AS balance", "CASE WHEN c_custkey % 40 = 3 THEN 0 ELSE 1 END AS active",
    )),
    "sales_orders": Binding("orders", (
        "o_orderkey AS id", "concat('SO', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS order_number",
        "o_custkey AS customer_id", "CAST(o_orderdate AS DATE) AS order_date",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate + INTERVAL '30' DAY AS DATE) END AS due_date",
        "CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'P' THEN 'delivered' "
        "WHEN o_orderpriority = '5-LOW' THEN 'cancelled' WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'pending' END AS status",
        "o_totalprice AS total_amount",
        f"CASE WHEN {_PAID_FULL} THEN o_totalprice WHEN o_orderstatus = 'P' THEN o_totalprice / 2 ELSE 0 END AS paid_amount",
        "CAST(0 AS DOUBLE) AS discount", "CAST(o_orderkey % 30 AS INT) AS created_by", _CREATED_AT,
    )),
    "sales_items": Binding("lineitem", (
        "l_orderkey AS order_id", "l_partkey AS product_id", "CAST(l_quantity AS INT) AS quantity",
        "l_extendedprice / l_quantity AS unit_price", "l_extendedprice AS subtotal",
    )),
    "payments": Binding("orders", (), oracle=(
        "SELECT o_orderkey * 2 + h.k AS id, o_orderkey AS order_id, "
        f"(CASE WHEN {_PAID_FULL} THEN o_totalprice ELSE o_totalprice / 2 END) / 2 AS amount, "
        "CAST(o_orderdate + (10 * h.k + 5) * INTERVAL '1' DAY AS DATE) AS payment_date, "
        "CASE o_orderkey % 4 WHEN 0 THEN 'cash' WHEN 1 THEN 'transfer' WHEN 2 THEN 'check' ELSE 'credit' END AS method, "
        "CAST(o_orderkey % 30 AS INT) AS created_by "
        "FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) h "
        "WHERE o_orderstatus IN ('F', 'P')"), tables=("orders",)),
    "deliveries": Binding("orders", (
        "o_orderkey AS id", "o_orderkey AS order_id", "concat('driver', CAST(o_orderkey % 12 AS STRING)) AS driver_name",
        "CAST(o_orderdate + INTERVAL '3' DAY AS DATE) AS delivery_date",
        "CASE WHEN o_orderstatus = 'P' THEN 'delivered' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'pending' END AS status",
        _CREATED_AT,
    ), where="o_orderstatus IN ('F', 'P')"),
    "production_orders": Binding("events", (
        "event_id AS id", "user_id AS product_id", "CAST(floor(value) AS BIGINT) + 1 AS quantity_planned",
        "CASE WHEN event_id % 10 > 4 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS quantity_produced",
        "CASE WHEN event_id % 10 < 2 THEN 'pending' WHEN event_id % 10 < 4 THEN 'in_progress' "
        "WHEN event_id % 10 = 4 THEN 'cancelled' ELSE 'completed' END AS status",
        "user_id % 30 AS created_by", "ts AS created_at",
    ), where="event_type = 'signup'"),
    "material_logs": Binding("events", (
        "event_id AS id", "user_id AS material_id",
        "CASE event_type WHEN 'click' THEN 'in' ELSE 'out' END AS type", "value AS quantity", "props AS note",
        "user_id % 30 AS created_by", "ts AS created_at",
    ), where="event_type IN ('click', 'view')"),
    "water_quality_tests": Binding("events", (
        "event_id AS id", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id - 1 END AS production_order_id",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 6 + CAST(event_id % 30 AS DOUBLE) / 10 END AS ph",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS tds",
        "CAST(event_id % 7 AS DOUBLE) / 4 AS turbidity",
        "CASE WHEN event_id % 9 = 0 THEN 'fail' WHEN event_id % 4 = 0 THEN 'pending' ELSE 'pass' END AS result",
        "CAST(ts AS DATE) AS test_date", "user_id % 30 AS created_by", "ts AS created_at",
    ), where="event_type = 'view'"),
    "expenses": Binding("events", (
        "event_id AS id",
        "CASE event_id % 9 WHEN 0 THEN 'electricity' WHEN 1 THEN 'water' WHEN 2 THEN 'labor' WHEN 3 THEN 'fuel' "
        "WHEN 4 THEN 'maintenance' WHEN 5 THEN 'packaging' WHEN 6 THEN 'transport' WHEN 7 THEN 'rent' "
        "ELSE 'other' END AS category",
        "value AS amount", "CAST(ts AS DATE) AS expense_date", "user_id % 30 AS created_by", "ts AS created_at",
    ), where="event_type = 'error'"),
    "suppliers": Binding("supplier", (
        "s_suppkey AS id", "concat('SUP', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS code", "s_name AS name",
        "CASE WHEN s_suppkey % 20 = 9 THEN 0 ELSE 1 END AS active",
    )),
    "purchase_orders": Binding("orders", (), oracle=(
        "SELECT o_orderkey AS id, concat('PO', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS po_number, supplier_id, "
        f"CAST(o_orderdate AS DATE) AS order_date, {_PO_STATUS}, o_totalprice AS total_amount, "
        f"CAST(o_orderkey % 30 AS INT) AS created_by, {_CREATED_AT} FROM orders LEFT JOIN "
        "(SELECT l_orderkey, min(l_suppkey) AS supplier_id FROM lineitem GROUP BY l_orderkey) li ON l_orderkey = o_orderkey"),
        tables=("orders", "lineitem")),
    "purchase_items": Binding("lineitem", (
        "l_orderkey AS po_id", "l_partkey AS material_id", "l_quantity AS quantity",
        "l_extendedprice / l_quantity AS unit_price", "l_extendedprice AS subtotal",
    )),
    "equipment": Binding("supplier", (
        "s_suppkey AS id", "concat('EQ', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS code", "s_name AS name",
        "CASE s_suppkey % 6 WHEN 4 THEN 'maintenance' WHEN 5 THEN 'inactive' ELSE 'active' END AS status",
        "CASE WHEN s_suppkey % 7 = 6 THEN NULL "
        "ELSE CAST(DATE '2024-01-10' + (s_suppkey % 30) * INTERVAL '1' DAY AS DATE) END AS next_maintenance",
    )),
    "maintenance_logs": Binding("events", (
        "event_id AS id", "user_id AS equipment_id",
        "CASE event_id % 3 WHEN 0 THEN 'repair' ELSE 'preventive' END AS maintenance_type", "value AS cost",
        "CAST(ts AS DATE) AS performed_date", "CAST(ts + INTERVAL '30' DAY AS DATE) AS next_due",
        "user_id % 30 AS created_by", "ts AS created_at",
    ), where="event_type = 'error'"),
    "container_deposits": Binding("events", (
        "event_id AS id", "user_id AS customer_id", "event_id % 7 AS quantity_out", "event_id % 5 AS quantity_returned",
        "value AS deposit_amount", "CAST(ts AS DATE) AS transaction_date", "user_id % 30 AS created_by",
        "ts AS created_at",
    ), where="event_type = 'purchase'"),
    "returns": Binding("events", (
        "event_id AS id", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id END AS order_id",
        "user_id AS product_id", "CAST(floor(value) AS BIGINT) + 1 AS quantity",
        "CASE event_id % 6 WHEN 0 THEN 'damaged' WHEN 1 THEN 'expired' WHEN 2 THEN 'quality' "
        "WHEN 3 THEN 'wrong_order' WHEN 4 THEN 'excess' ELSE 'other' END AS reason",
        "CAST(ts AS DATE) AS return_date",
        "CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status",
        "user_id % 30 AS created_by", "ts AS created_at",
    ), where="event_type = 'click'"),
    "delivery_routes": Binding("customer", (
        "c_custkey AS id", "c_name AS route_name",
        "CAST(DATE '2000-01-01' + c_nationkey * INTERVAL '1' DAY AS DATE) AS delivery_date",
        "CASE c_custkey % 3 WHEN 0 THEN 'planned' WHEN 1 THEN 'in_progress' ELSE 'completed' END AS status",
        "c_custkey % 20 AS total_orders", "c_nationkey AS created_by",
    )),
    "delivery_route_orders": Binding("orders", (), oracle=(
        "SELECT o_orderkey AS id, o_custkey AS route_id, o_orderkey AS order_id, "
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence_number "
        "FROM orders WHERE o_orderstatus = 'P'"), tables=("orders",)),
    "audit_logs": Binding("events", (
        "event_id AS id", "user_id % 30 AS user_id",
        "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'create' END AS action", "event_type AS entity",
        "event_id AS entity_id", "props AS details", "ts AS created_at",
    )),
    "app_settings_log": Binding("events", (
        "event_type AS key", "props AS value", "ts AS updated_at", "event_id AS seq",
    )),
    "order_events": Binding("events", (
        "event_id AS seq", "user_id AS order_id",
        "CASE event_type WHEN 'click' THEN 'set_status' WHEN 'view' THEN 'set_status' WHEN 'purchase' THEN 'payment' "
        "WHEN 'signup' THEN 'delivery_created' "
        "ELSE CASE WHEN event_id % 7 = 0 THEN 'cancel' ELSE 'delivery_status' END END AS kind",
        "CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'view' THEN 'delivered' WHEN 'error' THEN 'delivered' "
        "ELSE NULL END AS status",
        "CASE WHEN event_type = 'purchase' THEN value * 200 ELSE NULL END AS amount", "ts",
    )),
    "payment_attempts": Binding("orders", (), oracle=(
        "SELECT o_orderkey * 2 + h.k AS seq, o_orderkey AS order_id, "
        "o_totalprice * CASE WHEN (o_orderkey + h.k) % 5 = 0 THEN 0.75 ELSE 0.5 END AS amount "
        "FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) h"), tables=("orders",)),
    "production_events": Binding("events", (
        "event_id AS seq", "user_id AS order_id",
        "CASE event_type WHEN 'click' THEN 'in_progress' WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'completed' "
        "WHEN 'error' THEN 'cancelled' ELSE 'pending' END AS status",
        "CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS quantity_produced", "ts",
    )),
    "status_events": Binding("events", (
        "event_id AS seq", "user_id AS id", "CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'received' ELSE 'ordered' END AS status",
    )),
    "material_changes": Binding("events", (
        "event_id AS seq", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('M', lpad(CAST(user_id * 3 AS STRING), 9, '0')) END AS code",
        _OPS, "concat('name', CAST(event_id % 50 AS STRING)) AS name", "'box' AS unit", "value AS quantity",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 2 END AS min_quantity", "value / 2 AS cost_per_unit",
    )),
    "expense_changes": Binding("events", (
        "event_id AS seq", "CASE WHEN event_type = 'purchase' THEN NULL ELSE event_id END AS id",
        "CASE WHEN event_type = 'purchase' THEN 'insert' WHEN user_id % 2 = 0 THEN 'delete' ELSE 'update' END AS op",
        "event_type AS category", "value * 3 AS amount", "CAST(ts AS DATE) AS expense_date",
    )),
    "bom_changes": Binding("events", (
        "event_id AS seq", "user_id AS product_id", "user_id AS material_id", _OPS, "value AS quantity_per_unit",
    )),
    "delivery_changes": Binding("events", (
        "event_id AS seq", "event_id AS order_id", _OPS, "event_type AS status", "props AS driver_name",
    )),
    "order_status_changes": Binding("events", (
        "event_id AS seq", "CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS id", _OPS,
        "CASE event_type WHEN 'signup' THEN NULL WHEN 'click' THEN 'confirmed' ELSE 'delivered' END AS status",
        "value AS total_amount",
    )),
    "user_changes": Binding("events", (
        "event_id AS seq", "concat('user', CAST(user_id AS STRING)) AS username", _OPS,
        "concat('name', CAST(event_id % 50 AS STRING)) AS name", "CASE WHEN event_id % 4 = 0 THEN 'manager' END AS role",
    )),
    "product_changes": Binding("events", (
        "event_id AS seq", "concat('P', lpad(CAST(user_id * 2 AS STRING), 7, '0')) AS code",
        "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op",
        "concat('name', CAST(event_id % 50 AS STRING)) AS name", "value AS price", "ts",
    )),
}


def _explode_literal(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """Fan each row out over a short literal list (Generate node, no join)."""
    arr = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])
    return df.withColumn("_h", F.explode(arr)).select("*", *[F.col(f"_h.{n}").alias(n) for n in names]).drop("_h")


def _route_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr(
        "o_orderkey AS id", "o_custkey AS route_id", "o_orderkey AS order_id")


def _special(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "product_bom":
        m = _explode_literal(load_table(spark, sf_dir, "part").select("p_partkey", "p_size"), [(1, 0), (2, 1), (1, 2)], ["q", "k"])
        return m.selectExpr("p_partkey * 3 + k AS id", "p_partkey AS product_id",
                            "CASE k WHEN 0 THEN p_partkey WHEN 1 THEN CAST(p_size AS BIGINT) "
                            "ELSE CAST(floor(p_partkey / 2.0) AS BIGINT) END AS material_id",
                            "CAST(q AS DOUBLE) AS quantity_per_unit")
    if name == "payments":
        o = load_table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'P')")
        h = _explode_literal(o, [(0,), (1,)], ["k"])
        return h.selectExpr(
            "o_orderkey * 2 + k AS id", "o_orderkey AS order_id",
            f"(CASE WHEN {_PAID_FULL} THEN o_totalprice ELSE o_totalprice / 2 END) / 2 AS amount",
            "CAST(o_orderdate + (10 * k + 5) * INTERVAL '1' DAY AS DATE) AS payment_date",
            "CASE o_orderkey % 4 WHEN 0 THEN 'cash' WHEN 1 THEN 'transfer' WHEN 2 THEN 'check' ELSE 'credit' END AS method",
            "CAST(o_orderkey % 30 AS INT) AS created_by")
    if name == "payment_attempts":
        h = _explode_literal(load_table(spark, sf_dir, "orders"), [(0,), (1,)], ["k"])
        return h.selectExpr("o_orderkey * 2 + k AS seq", "o_orderkey AS order_id",
                            "o_totalprice * CASE WHEN (o_orderkey + k) % 5 = 0 THEN 0.75 ELSE 0.5 END AS amount")
    if name == "purchase_orders":
        own = load_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("supplier_id"))
        return load_table(spark, sf_dir, "orders").join(own, "o_orderkey", "left").selectExpr(
            "o_orderkey AS id", "concat('PO', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS po_number", "supplier_id",
            "CAST(o_orderdate AS DATE) AS order_date", _PO_STATUS, "o_totalprice AS total_amount",
            "CAST(o_orderkey % 30 AS INT) AS created_by", _CREATED_AT)
    if name == "delivery_route_orders":
        return running_count(_route_stops(spark, sf_dir), ["route_id"], ["order_id"], "sequence_number") \
            .select("id", "route_id", "order_id", "sequence_number")
    raise KeyError(name)


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The factory table ``name`` as a lazy projection of the driver tables."""
    b = BINDINGS[name]
    if b.oracle:
        return _special(spark, sf_dir, name)
    df = load_table(spark, sf_dir, b.source)
    if b.where:
        df = df.where(b.where)
    return df.selectExpr(*b.exprs)


class Tables:
    """Lazy accessor: ``t.sales_orders`` binds on first use.

    Bound frames are plain lazy plans (no data is cached). They live as long as
    this object: a frame holds the file listing of its first use, so a new
    ``Tables`` sees files that were added since."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._bound = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in BINDINGS:
            raise AttributeError(name)
        if name not in self._bound:
            self._bound[name] = bind(self.spark, self.sf_dir, name)
        return self._bound[name]


    def stored(self, source: str) -> DataFrame:
        """A stored table as it is."""
        return load_table(self.spark, self.sf_dir, source)

    def stored_column(self, name: str, col: str) -> tuple[str, Column] | None:
        """A column of a table that is a plain projection: (stored table, the column over it, NULL in
        rows that the table leaves out); None for other tables."""
        b = BINDINGS[name]
        if b.oracle:
            return None
        text = next(e.rsplit(" AS ", 1)[0] for e in b.exprs if e.rsplit(" AS ", 1)[-1].strip() == col)
        return b.source, F.when(F.expr(b.where), F.expr(text)) if b.where else F.expr(text)

    def keys_of(self, name: str) -> DataFrame:
        """A table of which only keys are needed: what is numbered within a group stays unnumbered."""
        if name == "delivery_route_orders":
            return _route_stops(self.spark, self.sf_dir)
        return getattr(self, name)


def with_bindings(sql: str) -> str:
    """Prefix an oracle query with CTEs for every binding it names."""
    used = [n for n in BINDINGS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({BINDINGS[n].sql()})" for n in used)
    m = re.match(r"(?is)^\s*WITH\s+(RECURSIVE\s+)?", sql)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{sql[m.end():]}"
    return f"WITH {ctes}\n{sql}"


_SPECIAL_COLUMNS = {
    "product_bom": ["id", "product_id", "material_id", "quantity_per_unit"],
    "payments": ["id", "order_id", "amount", "payment_date", "method", "created_by"],
    "delivery_route_orders": ["id", "route_id", "order_id", "sequence_number"],
    "payment_attempts": ["seq", "order_id", "amount"],
    "purchase_orders": ["id", "po_number", "supplier_id", "order_date", "status", "total_amount", "created_by", "created_at"],
}


def binding_columns(name: str) -> list[str]:
    """Output column names of a binding, without running anything."""
    if name in _SPECIAL_COLUMNS:
        return list(_SPECIAL_COLUMNS[name])
    return [e.rsplit(" AS ", 1)[1].strip() if " AS " in e else e.strip() for e in BINDINGS[name].exprs]
