"""2L: the reference's enforced constraints as batch data-quality checks.

Spark does not enforce keys, so each rule becomes a query: one group-by over
the keys of parents and children for foreign keys, group-by counts for uniqueness, one conditional-count pass per
table for NOT NULL. Every check returns small result rows (counts or the
offending keys), never the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import msum

# The reference's 19 foreign keys as (child table, column, parent table).
FOREIGN_KEYS = [
    ("material_logs", "material_id", "raw_materials"),
    ("production_orders", "product_id", "products"),
    ("sales_orders", "customer_id", "customers"),
    ("sales_items", "order_id", "sales_orders"),
    ("sales_items", "product_id", "products"),
    ("deliveries", "order_id", "sales_orders"),
    ("payments", "order_id", "sales_orders"),
    ("water_quality_tests", "production_order_id", "production_orders"),
    ("product_bom", "product_id", "products"),
    ("product_bom", "material_id", "raw_materials"),
    ("purchase_orders", "supplier_id", "suppliers"),
    ("purchase_items", "po_id", "purchase_orders"),
    ("purchase_items", "material_id", "raw_materials"),
    ("maintenance_logs", "equipment_id", "equipment"),
    ("container_deposits", "customer_id", "customers"),
    ("returns", "order_id", "sales_orders"),
    ("returns", "product_id", "products"),
    ("delivery_route_orders", "route_id", "delivery_routes"),
    ("delivery_route_orders", "order_id", "sales_orders"),
]

# Single-column UNIQUE constraints, plus the app-level ones.
UNIQUE_KEYS = [
    ("users", ["username"]), ("raw_materials", ["code"]), ("products", ["code"]), ("customers", ["code"]),
    ("sales_orders", ["order_number"]), ("suppliers", ["code"]), ("purchase_orders", ["po_number"]),
    ("equipment", ["code"]), ("product_bom", ["product_id", "material_id"]), ("deliveries", ["order_id"]),
]

# NOT NULL columns per table (password is not carried).
REQUIRED = {
    "users": ["username", "name", "role"],
    "raw_materials": ["code", "name", "unit"],
    "material_logs": ["material_id", "type", "quantity"],
    "products": ["code", "name"],
    "production_orders": ["product_id", "quantity_planned"],
    "customers": ["code", "name"],
    "sales_orders": ["order_number", "customer_id", "order_date"],
    "sales_items": ["order_id", "product_id", "quantity", "unit_price", "subtotal"],
    "deliveries": ["order_id"],
    "payments": ["order_id", "amount", "payment_date"],
    "water_quality_tests": ["test_date"],
    "product_bom": ["product_id", "material_id", "quantity_per_unit"],
    "expenses": ["category", "amount", "expense_date"],
    "suppliers": ["code", "name"],
    "purchase_orders": ["po_number", "supplier_id", "order_date"],
    "purchase_items": ["po_id", "material_id", "quantity", "unit_price", "subtotal"],
    "equipment": ["code", "name"],
    "maintenance_logs": ["equipment_id", "maintenance_type", "performed_date"],
    "container_deposits": ["customer_id", "transaction_date"],
    "returns": ["quantity", "reason", "return_date"],
    "delivery_routes": ["route_name", "delivery_date"],
    "delivery_route_orders": ["route_id", "order_id"],
    "audit_logs": ["action", "entity"],
}


def _key_pairs(tables) -> DataFrame:
    """(parent, slot, k): slot 0 for a key that ``parent`` has, slot n for a row of its n-th child column.
    Tables that are plain projections of one stored table are read in one scan of it."""
    parents = {p: i for i, p in enumerate(dict.fromkeys(p for *_, p in FOREIGN_KEYS))}
    wanted = [(p, "id", i, 0) for p, i in parents.items()]
    slots = dict.fromkeys(parents, 0)
    for child, col, parent in FOREIGN_KEYS:
        slots[parent] += 1
        wanted.append((child, col, parents[parent], slots[parent]))
    frames: dict[str, tuple[DataFrame, list]] = {}
    for table, col, parent, slot in wanted:
        found = tables.stored_column(table, col)
        source, df, key = (found[0], None, found[1]) if found else (f"{table}.", tables.keys_of(table), F.col(col))
        if source not in frames:
            frames[source] = (df if df is not None else tables.stored(source), [])
        pair = F.struct(F.lit(parent).cast("tinyint").alias("parent"), F.lit(slot).cast("tinyint").alias("slot"), key.cast("long").alias("k"))
        frames[source][1].append(pair)
    return reduce(DataFrame.unionByName, [df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("k IS NOT NULL")
                                          for df, pairs in frames.values()])


def fk_orphans(tables) -> DataFrame:
    """L1: per foreign key, the number of child rows whose (non-NULL) key has no parent.

    One scan per stored table gives the keys of all its parents and child columns, and one group-by
    over (parent, key) decides: whether the parent has the key, and how many rows of each of its child
    columns hold it. It counts map-side, so a hot key shrinks to a row per task, and nothing is joined."""
    slots = max(sum(p == q for *_, q in FOREIGN_KEYS) for *_, p in FOREIGN_KEYS)
    rows = [F.count_if(F.col("slot") == n).alias(f"n{n}") for n in range(slots + 1)]
    lost = _key_pairs(tables).groupBy("parent", "k").agg(*rows).where("n0 = 0")
    lost = lost.groupBy("parent").agg(*[F.sum(f"n{n}").alias(f"n{n}") for n in range(1, slots + 1)])
    lost = lost.select("parent", F.posexplode(F.array(*[F.col(f"n{n}") for n in range(1, slots + 1)])).alias("slot", "n"))
    parents, seen, names = {p: i for i, p in enumerate(dict.fromkeys(p for *_, p in FOREIGN_KEYS))}, {}, []
    for child, col, parent in FOREIGN_KEYS:
        seen[parent] = seen.get(parent, -1) + 1
        names.append((f"{child}.{col}", parent, parents[parent], seen[parent]))
    names = tables.spark.createDataFrame(names, "fk string, parent string, p tinyint, s int")
    return names.join(lost.select(F.col("parent").alias("p"), F.col("slot").alias("s"), "n"), ["p", "s"], "left").select(
        "fk", "parent", F.coalesce("n", F.lit(0)).cast("long").alias("orphan_rows"))


def unique_violations(tables, settings: DataFrame | None = None) -> DataFrame:
    """L2: keys that occur more than once, with their row count."""
    parts = []
    specs = list(UNIQUE_KEYS) + ([("app_settings", ["key"])] if settings is not None else [])
    for table, cols in specs:
        df = settings if table == "app_settings" else getattr(tables, table)
        g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        parts.append(g.select(F.lit(f"{table}({','.join(cols)})").alias("constraint"),
                              F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"), "n"))
    return reduce(DataFrame.unionByName, parts)


def required_nulls(tables) -> DataFrame:
    """L3: NULL count per NOT NULL column (one pass per table), non-zero only."""
    parts = []
    for table, cols in REQUIRED.items():
        df = getattr(tables, table)
        present = [c for c in cols if c in df.columns]
        if not present:
            continue
        counts = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(c) for c in present])
        stacked = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"))
                                                     for c in present])).alias("s")).select("s.*")
        parts.append(stacked.select(F.lit(table).alias("table"), "column", "nulls"))
    out = reduce(DataFrame.unionByName, parts)
    return out.where(F.col("nulls") > 0)


def reconcile_totals(o: DataFrame, items: DataFrame, pay: DataFrame, dr: DataFrame, dro: DataFrame) -> DataFrame:
    """L4: stored vs recomputed: order total = items - discount, paid = payments,
    route total_orders = stops. Only differing rows are returned."""
    it = items.groupBy("order_id").agg(msum("subtotal").alias("_items"))
    pp = pay.groupBy("order_id").agg(msum("amount").alias("_paid"))
    oo = o.select(F.col("id").alias("order_id"), "total_amount", "paid_amount", "discount") \
        .join(it, "order_id", "left").join(pp, "order_id", "left")
    tot = oo.select(F.lit("order_total").alias("check"), F.col("order_id").alias("id"),
                    F.col("total_amount").alias("stored"),
                    (F.coalesce("_items", F.lit(0.0)) - F.coalesce("discount", F.lit(0.0))).alias("computed"))
    paid = oo.select(F.lit("paid_amount").alias("check"), F.col("order_id").alias("id"),
                     F.col("paid_amount").alias("stored"), F.coalesce("_paid", F.lit(0.0)).alias("computed"))
    cnt = dro.groupBy("route_id").agg(F.count(F.lit(1)).alias("_n"))
    rt = dr.join(cnt.withColumnRenamed("route_id", "id"), "id", "left").select(
        F.lit("route_total_orders").alias("check"), "id", F.col("total_orders").cast("double").alias("stored"),
        F.coalesce("_n", F.lit(0)).cast("double").alias("computed"))
    out = tot.unionByName(paid).unionByName(rt)
    return out.where(F.abs(F.col("stored") - F.col("computed")) > 0.005)


def duplicate_batches(po: DataFrame) -> DataFrame:
    """Batch numbers used more than once (possible after a cancellation)."""
    return po.where(F.col("batch_number").isNotNull()).groupBy("batch_number") \
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")) \
        .where(F.col("n") > 1)
