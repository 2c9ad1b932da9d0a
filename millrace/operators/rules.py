"""2I: the reference's write-time business rules, re-aimed as bulk jobs.

Input is a table of changes/events with a total order (timestamp, id); output
is new state, movements and rejects. Rules with an associative form are plain
group-bys, windows and joins (movement sums, the clamped stock ledger, master
data changes, settings, the order life cycle). Where each decision depends on
the earlier *accepted* ones, credit checks go in rounds of prefix sums
(``plans.rounds``); payments and stock adjustments after a key's first refusal
run through ``plans.fold.sorted_fold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.scalars import MONEY, msum
from millrace.plans.fold import sorted_fold
from millrace.plans.rounds import capacity_rounds, written
from millrace.plans.scan import block_cuts, carried, clamped_balance, fill_before, prefix_sums, previous_value, running_count

OPEN = ("paid", "cancelled")


# ----------------------------------------------------------------------------- I1
# What a change may touch, per entity: the key, the columns an update may set, defaults
# on insert, and what a delete does (hard: the row goes; soft: active = 0; status: status becomes
# cancelled; none: refused), and stamps: the column that takes a change's time when it sets another
# column to a value. Entities keyed by id get their ids from inserts.
CHANGE_SPECS = {
    "raw_materials": {"key": "code", "updatable": ["name", "unit", "min_quantity", "cost_per_unit"],
                      "insert_defaults": {"quantity": 0.0, "min_quantity": 0.0, "cost_per_unit": 0.0},
                      "delete": "hard"},
    "products": {"key": "code", "updatable": ["name", "size_ml", "unit", "price", "cost", "min_stock"],
                 "insert_defaults": {"unit": "ขวด", "size_ml": 0, "cost": 0.0, "stock": 0, "min_stock": 0},
                 "delete": "soft"},
    "customers": {"key": "code", "updatable": ["name", "phone", "address", "type", "credit_limit"],
                  "insert_defaults": {"type": "retail", "credit_limit": 0.0, "balance": 0.0}, "delete": "soft"},
    "suppliers": {"key": "code", "updatable": ["name", "contact_person", "phone", "email", "address", "notes"],
                  "insert_defaults": {}, "delete": "soft"},
    "equipment": {"key": "code", "updatable": ["name", "type", "model", "location", "status", "notes"],
                  "insert_defaults": {"status": "active"}, "delete": "hard"},
    "users": {"key": "username", "updatable": ["name", "role", "active"], "insert_defaults": {"role": "staff", "active": 1},
              "delete": "hard", "protected": ["admin"]},
    "expenses": {"key": "id", "updatable": ["category", "description", "amount", "expense_date", "receipt_ref", "vendor"],
                 "insert_defaults": {}, "delete": "hard"},
    "water_quality_tests": {"key": "id", "updatable": ["ph", "tds", "turbidity", "chlorine", "hardness", "temperature", "odor",
                                                       "taste", "result", "tester", "notes"],
                            "insert_defaults": {"odor": "ปกติ", "taste": "ปกติ", "result": "pending"}, "delete": "hard"},
    "product_bom": {"key": ["product_id", "material_id"], "updatable": [], "insert_defaults": {}, "delete": "hard"},
    "production_orders": {"key": "id", "updatable": ["status"], "insert_defaults": {"status": "pending"}, "delete": "status"},
    "sales_orders": {"key": "id", "updatable": ["status"], "insert_defaults": {"status": "pending"}, "delete": "status"},
    "deliveries": {"key": "order_id", "updatable": ["status", "driver_name", "vehicle", "delivery_date", "notes"],
                   "insert_defaults": {"status": "pending"}, "delete": "none",
                   "stamps": {"delivered_at": ("status", "delivered", "ts")}},
    "returns": {"key": "id", "updatable": ["status", "action_taken"], "insert_defaults": {"status": "pending"}, "delete": "none"},
    "delivery_routes": {"key": "id", "updatable": ["status"], "insert_defaults": {"status": "planned"}, "delete": "none"},
    "purchase_orders": {"key": "id", "updatable": ["status"], "insert_defaults": {"status": "draft"}, "delete": "none"},
}


def apply_changes(current: DataFrame, changes: DataFrame, spec: dict | str = "products",
                  seq: str = "seq", top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert / update / delete change rows onto a table, in ``seq`` order.

    An insert is accepted if its key is not in use (a soft-deleted key stays in
    use, a hard-deleted one is free again); updates and deletes need the key in
    use. An insert sets every column that the change carries, defaults fill its
    NULLs, and it gets the next id (largest id + n); an update sets the spec's
    columns only. Rejected: a NULL key (``missing_key``), ``duplicate_key``,
    ``not_found``, ``protected`` keys and deletes where the entity has none
    (``not_allowed``), other ops (``bad_op``). Returns ``(state, rejects)``. ``top``
    is the largest id in use, where ``current`` holds a part of the table only.

    Whether a key is in use before a change follows from the last insert or hard
    delete attempt before it (either way it leaves the key used or free), a
    forward fill on the two-level block scan: no per-key ordering pass."""
    spec = CHANGE_SPECS[spec] if isinstance(spec, str) else spec
    keys = [spec["key"]] if isinstance(spec["key"], str) else list(spec["key"])
    mode, has_id = spec["delete"], "id" in current.columns
    op, is_ins, is_del = F.col("op"), F.col("op").eqNullSafe("insert"), F.col("op").eqNullSafe("delete")
    top = F.lit(top) if top is not None else current.agg(F.max("id")).scalar() if has_id else F.lit(0)

    def next_ids(rows: DataFrame, name: str) -> DataFrame:
        return running_count(rows, [], [seq], "_n").withColumn(
            name, F.coalesce(top, F.lit(0)).cast("long") + F.col("_n")).drop("_n")

    ch = changes
    for c, v in spec["insert_defaults"].items():
        if c in ch.columns:
            ch = ch.withColumn(c, F.when(is_ins, F.coalesce(F.col(c), F.lit(v))).otherwise(F.col(c)))
    if keys == ["id"]:
        new = next_ids(ch.where(is_ins).drop("id"), "id")
        ch = ch.where(~is_ins).unionByName(new, allowMissingColumns=True)
    used = current.select(*keys, F.lit(True).alias("_used")).dropDuplicates(keys)
    ch = ch.join(used, keys, "left")
    protected = F.coalesce(F.col(keys[0]).isin(*spec["protected"]), F.lit(False)) if spec.get("protected") else F.lit(False)
    ch = fill_before(ch, keys, [seq], F.when(is_ins, True).when(is_del & ~protected & F.lit(mode == "hard"), False), "_prev")
    exists = F.coalesce("_prev", "_used", F.lit(False))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    ch = ch.withColumn("_why", F.when(missing, "missing_key").when(~F.coalesce(op.isin("insert", "update", "delete"), F.lit(False)), "bad_op")
                       .when(is_ins & exists, "duplicate_key").when(~is_ins & ~exists, "not_found")
                       .when(is_del & protected, "protected").when(is_del & F.lit(mode == "none"), "not_allowed"))
    rejects = ch.where("_why IS NOT NULL").select(seq, *keys, "op", F.col("_why").alias("reason"))
    ok = ch.where("_why IS NULL").drop("_prev", "_used", "_why")
    if has_id and keys != ["id"]:
        new = next_ids(ok.where(is_ins).drop("id"), "_new_id")
        ok = ok.where(~is_ins).unionByName(new, allowMissingColumns=True)
    stamps = {c: s for c, s in spec.get("stamps", {}).items() if s[2] in changes.columns}
    upd = [c for c in spec["updatable"] if c in changes.columns and c in current.columns]
    ins = [c for c in current.columns if c in changes.columns and c not in keys and c != "id"]
    at = lambda cond: F.when(cond, F.col(seq))
    agg = ok.groupBy(*keys).agg(
        F.max(at(is_ins)).alias("_ins_at"), F.max(at(is_del)).alias("_del_at"), F.max(at(~is_del)).alias("_set_at"),
        F.max_by(F.struct(F.lit(True).alias("_"), *ins, *([F.col("_new_id")] if has_id and keys != ["id"] else [])), at(is_ins)).alias("_i"),
        F.max_by(F.struct(F.lit(True).alias("_"), *upd), at(~is_del)).alias("_u"),
        *[F.max_by(F.col(ts), at(~is_del & (F.col(src) == value))).alias(f"_at_{c}") for c, (src, value, ts) in stamps.items()])
    st = current.withColumn("_here", F.lit(True)).join(agg, keys, "full_outer")
    new = F.col("_ins_at").isNotNull()
    gone = F.col("_del_at").isNotNull() & (F.col("_ins_at").isNull() | (F.col("_del_at") > F.col("_ins_at")))
    defaults = spec["insert_defaults"]
    cols = []
    for c in current.columns:
        kind = current.schema[c].dataType
        if c in keys:
            v = F.col(c)
        elif c == "id":
            v = F.when(new, F.col("_i._new_id")).otherwise(F.col("id"))
        elif c in stamps:
            v = F.coalesce(F.col(f"_at_{c}"), F.when(~new, F.col(c)))
        else:
            first = F.col(f"_i.{c}") if c in ins else F.lit(defaults.get(c, 1 if c == "active" and mode == "soft" else None))
            v = F.when(new, first).otherwise(F.col(c))
            if c in upd:
                v = F.when(F.col("_set_at").isNotNull(), F.col(f"_u.{c}")).otherwise(v)
            if c == "active" and mode == "soft":
                v = F.when(F.col("_del_at").isNotNull(), F.lit(0)).otherwise(v)
            if c == "status" and mode == "status":
                v = F.when(F.col("_del_at") > F.coalesce("_set_at", F.col("_del_at") - 1), "cancelled").otherwise(v)
        cols.append(v.cast(kind).alias(c))
    cols += [F.col(f"_at_{c}").alias(c) for c in stamps if c not in current.columns]
    state = st.where(F.col("_here").isNotNull() | new)
    return (state.where(~gone) if mode == "hard" else state).select(*cols), rejects


# ----------------------------------------------------------------------------- I2 / I4
def price_orders(items: DataFrame, headers: DataFrame | None = None, key: str = "order_id") -> DataFrame:
    """I4: line subtotal = qty x price; order total = sum(subtotals) - discount."""
    lines = items.withColumn("subtotal", F.col("quantity") * F.col("unit_price"))
    tot = lines.groupBy(key).agg(msum("subtotal").alias("items_total"), F.count(F.lit(1)).alias("line_count"))
    if headers is None:
        return tot.withColumn("total", F.col("items_total"))
    h = headers.select(F.col("id").alias(key), F.coalesce("discount", F.lit(0.0)).alias("discount"))
    return h.join(tot, key, "left").withColumn(
        "total", F.coalesce("items_total", F.lit(0.0)) - F.col("discount"))


# I2 reasons in the order the reference checks them.
ORDER_REASONS = ["missing_fields", "credit_limit", "bad_quantity", "bad_price", "unknown_product",
                 "insufficient_stock"]


def validate_sales_orders(orders: DataFrame, items: DataFrame, customers: DataFrame, products: DataFrame,
                          open_orders: DataFrame) -> DataFrame:
    """The first failing rule per new order (``reason`` NULL = valid).

    Order: missing fields (customer 0 counts as none); credit limit (only when limit > 0: open outstanding +
    new total > limit); then line by line (``line_no`` order): quantity <= 0,
    price missing/0/negative, unknown product, stock < quantity. Lines are
    checked separately, so two lines of one product can together exceed stock."""
    tot = items.groupBy("order_id").agg(msum(F.col("quantity") * F.col("unit_price")).alias("_items_total"),
                                        F.count(F.lit(1)).alias("_lines"))
    owed = open_orders.where(~F.col("status").isin(*OPEN)).groupBy("customer_id") \
        .agg(msum(F.col("total_amount") - F.col("paid_amount")).alias("_owed"))
    cust = customers.select(F.col("id").alias("customer_id"), "credit_limit")
    new_total = F.coalesce("_items_total", F.lit(0.0)) - F.col("_disc")
    hdr_reason = (F.when(F.coalesce(F.col("customer_id") == 0, F.lit(True)) | F.col("order_date").isNull()
                         | F.coalesce(F.col("_lines"), F.lit(0)).__eq__(0), F.lit(0))
                  .when((F.col("credit_limit") > 0)
                        & (F.coalesce("_owed", F.lit(0.0)) + new_total > F.col("credit_limit")), F.lit(1)))
    prod = products.select(F.col("id").alias("product_id"), F.col("stock").alias("_stock"), F.lit(True).alias("_known"))
    li = items.join(prod, "product_id", "left")
    q, pr = F.col("quantity"), F.col("unit_price")
    line_rule = (F.when(q.isNull() | (q <= 0), F.lit(2)).when(pr.isNull() | (pr <= 0), F.lit(3))
                 .when(F.col("_known").isNull(), F.lit(4)).when(F.col("_stock") < q, F.lit(5)))
    first_line = li.where(line_rule.isNotNull()).groupBy("order_id").agg(
        F.min_by(line_rule, F.struct("line_no", line_rule)).alias("_line_rule"))
    # order-keyed inputs first (one partitioning on order_id), then the
    # customer-keyed ones (one re-partitioning on customer_id)
    out = (orders.select(F.col("id").alias("order_id"), "customer_id", "order_date",
                         F.coalesce("discount", F.lit(0.0)).alias("_disc"))
           .join(tot, "order_id", "left").join(first_line, "order_id", "left")
           .join(cust, "customer_id", "left").join(owed, "customer_id", "left"))
    rule = F.coalesce(hdr_reason, F.col("_line_rule"))
    reasons = F.array(*[F.lit(r) for r in ORDER_REASONS])
    return out.select("order_id", "customer_id", new_total.alias("new_total"),
                      F.when(rule.isNotNull(), F.element_at(reasons, rule + 1)).alias("reason"))


# ----------------------------------------------------------------------------- I3
def credit_replay(orders: DataFrame, customers: DataFrame, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The credit rule in sequence per customer: an order is accepted when
    the limit is not positive or ``outstanding + total <= limit``; only accepted
    orders raise the outstanding sum.

    Customers without a positive limit accept everything, so their outstanding
    is a plain running sum (two-level prefix sum: no customer in one task). The
    others' rows are decided in rounds that each halve what is left of the limit
    (``plans.rounds.capacity_rounds``): running sums again, never a customer in
    one task. Money is handled in exact 1e-4 units (``decimal(18,4)``), as
    everywhere else."""
    extra = [c for c in order if c not in ("id", "customer_id", "total_amount")]
    x = (orders.select("id", "customer_id", "total_amount", *extra)
         .join(customers.select(F.col("id").alias("customer_id"), "credit_limit"), "customer_id", "left")
         .withColumn("_tot_u", (F.coalesce(F.col("total_amount"), F.lit(0.0)).cast(MONEY) * 10000).cast("long"))
         .withColumn("_lim_u", (F.col("credit_limit").cast(MONEY) * 10000).cast("long")))
    limited = F.col("_lim_u") > 0
    free = x.where(~limited | F.col("_lim_u").isNull())
    free = prefix_sums(free, ["customer_id"], list(order), {"_owed_u": F.col("_tot_u")}) \
        .select("id", "customer_id", F.lit(True).alias("accepted"),
                (F.col("_owed_u").cast("decimal(38,0)") / 10000).cast("double").alias("outstanding_after"))

    capped = capacity_rounds(x.where(limited), "customer_id", list(order), "_tot_u", "_lim_u").select(
        "id", "customer_id", "accepted", _to_money(F.col("used")).alias("outstanding_after"))
    return free.unionByName(capped)


# ----------------------------------------------------------------------------- I5-I7
def produced_qty(po: DataFrame) -> Column:
    """``quantity_produced``, or the planned quantity when it is 0 or NULL."""
    return F.coalesce(F.when(F.col("quantity_produced") != 0, F.col("quantity_produced")), F.col("quantity_planned"))


def bom_requirements(po: DataFrame, bom: DataFrame, m: DataFrame) -> DataFrame:
    """Completed production x BOM -> one material need per (order, BOM line),
    with the ledger note, the material's cost and its shortage vs stock."""
    done = po.where(F.col("status") == "completed").select(
        F.col("id").alias("production_order_id"), "product_id", produced_qty(po).alias("produced"),
        (F.col("batch_number") if "batch_number" in po.columns else F.lit(None).cast("string")).alias("batch_number"),
        "created_at")
    need = done.join(bom, "product_id").withColumn("need", F.col("quantity_per_unit") * F.col("produced"))
    mm = m.select(F.col("id").alias("material_id"), F.col("name").alias("material_name"), "cost_per_unit",
                  F.col("quantity").alias("stock"))
    return need.join(mm, "material_id", "left").select(
        "production_order_id", "product_id", "material_id", "material_name", "produced", "need",
        (F.col("need") * F.col("cost_per_unit")).alias("material_cost"),
        F.greatest(F.col("need") - F.col("stock"), F.lit(0.0)).alias("shortage"),
        F.format_string("ผลิต Batch: %s x%s", F.coalesce("batch_number", F.lit("N/A")),
                        F.col("produced").cast("string")).alias("note"), "created_at")


def material_needs(req: DataFrame) -> DataFrame:
    """Total need and cost per material."""
    return req.groupBy("material_id").agg(msum("need").alias("need"), msum("material_cost").alias("material_cost"))


def production_stock_moves(po: DataFrame) -> DataFrame:
    """Completed production adds the produced quantity to product stock."""
    return po.where(F.col("status") == "completed").groupBy("product_id") \
        .agg(F.sum(produced_qty(po)).cast("long").alias("produced"))


def production_replay(po: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I6 over status events (order_id, status, quantity_produced, ts, seq): the
    orders as the events leave them, and one stock move per completion.

    ``started_at`` is set by the first ``in_progress`` and kept; every
    ``completed`` sets ``completed_at`` and ``quantity_produced`` (the planned
    quantity where it is 0 or missing) and adds to stock again: no repeat guard,
    as in the reference. Events of unknown orders do nothing."""
    pos = F.struct("ts", "seq")
    e = events.join(po.select(F.col("id").alias("order_id"), "product_id", "quantity_planned"), "order_id")
    done = F.col("status") == "completed"
    made = F.coalesce(F.when(F.col("quantity_produced") != 0, F.col("quantity_produced")), F.col("quantity_planned"))
    moves = e.where(done).select("order_id", "product_id", made.alias("quantity"), "ts", "seq")
    last = e.groupBy("order_id").agg(
        F.max_by("status", pos).alias("_status"), F.min(F.when(F.col("status") == "in_progress", F.col("ts"))).alias("_started"),
        F.max(F.when(done, F.col("ts"))).alias("_completed"), F.max_by(made, F.when(done, pos)).alias("_made"))
    x = po.join(last.withColumnRenamed("order_id", "id"), "id", "left")
    had = F.col("started_at") if "started_at" in po.columns else F.lit(None).cast("timestamp_ntz")
    old = F.col("completed_at") if "completed_at" in po.columns else F.lit(None).cast("timestamp_ntz")
    keep = [c for c in po.columns if c not in ("status", "quantity_produced", "started_at", "completed_at")]
    return x.select(*keep, F.coalesce("_status", "status").alias("status"),
                    F.coalesce(F.col("_made"), F.col("quantity_produced")).alias("quantity_produced"),
                    F.coalesce(had, F.col("_started")).alias("started_at"), F.coalesce(F.col("_completed"), old).alias("completed_at")), moves


def _times(events: DataFrame, key: str, status: str) -> DataFrame:
    """How often each row's events set ``status``."""
    return events.where(F.col("status") == status).groupBy(F.col("id").alias(key)).agg(F.count(F.lit(1)).alias("_times"))


def po_receipts(po: DataFrame, items: DataFrame, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Received POs: ``in`` log rows (one per line, note = PO number) and the
    quantity added per material. No repeat guard, as in the reference: with
    status ``events(id, status)`` every event that sets ``received`` adds the
    lines again; without, each PO that is received counts once."""
    rec = po.select(F.col("id").alias("po_id"), "po_number", "created_by", "status")
    if events is None:
        rec = rec.where(F.col("status") == "received")
    else:
        rec = rec.join(_times(events, "po_id", "received"), "po_id").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    logs = items.join(rec, "po_id").select("po_id", "material_id", F.lit("in").alias("type"), "quantity",
                                           F.concat(F.lit("รับจาก PO: "), F.col("po_number")).alias("note"),
                                           "created_by")
    per = logs.groupBy("material_id").agg(msum("quantity").alias("received"))
    return logs, per


# ----------------------------------------------------------------------------- I8
def material_ledger(initial: DataFrame, moves: DataFrame) -> DataFrame:
    """I8: running stock per material: ``in`` adds, ``out`` (BOM use) subtracts
    and floors at 0. Closed form over windows (``plans.scan.clamped_balance``)."""
    x = moves.join(initial.select(F.col("id").alias("material_id"), F.col("quantity").alias("_x0")),
                   "material_id", "left")
    delta = F.when(F.col("type") == "in", F.col("quantity")).otherwise(-F.col("quantity"))
    return clamped_balance(x, ["material_id"], ["created_at", "id"], delta, F.col("type") != "in",
                           F.coalesce("_x0", F.lit(0.0)), cuts=block_cuts(moves, "created_at", "id")).drop("_x0")


# ----------------------------------------------------------------------------- I9
def _units(c: Column) -> Column:
    """Money/quantity as exact 1e-4 units (``long``); NULL stays NULL."""
    return (c.cast(MONEY) * 10000).cast("long")


def _to_money(c: Column) -> Column:
    return (c.cast("decimal(38,0)") / 10000).cast("double")


def material_adjust_replay(initial: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Manual adjustments in sequence per material: a missing quantity or one
    <= 0 is rejected, then an unknown (or NULL) material; ``in`` adds, any other
    type subtracts; a result below 0 is rejected and leaves stock unchanged. One
    output row per adjustment with ``accepted``, ``reason`` and ``balance`` after
    it (exact 1e-4 units; NULL for an unknown material).

    Running sums, then repair: as long as no adjustment would take a material
    below zero, every valid one is accepted and the balance is a plain running
    sum - computed with the two-level scan, so a hot material is spread over
    many tasks. Only from a material's first would-be-negative adjustment on
    do decisions depend on earlier rejections; those rows (and only those)
    go through the sequential fold, starting from the balance just before."""
    x = adjustments.select("id", "material_id", "type", "quantity", "created_at").join(
        initial.select(F.col("id").alias("material_id"), F.coalesce(_units(F.col("quantity")), F.lit(0).cast("long")).alias("_x0_u"),
                       F.lit(True).alias("_known")), "material_id", "left")
    amount = F.col("quantity").isNotNull() & (F.col("quantity") > 0)
    known = F.coalesce("_known", F.lit(False))
    reason0 = F.when(~amount, F.lit("bad_quantity")).when(~known, F.lit("unknown_material"))
    no = F.lit(None).cast("double")
    nowhere = x.where(~known).select("id", "material_id", F.lit(False).alias("accepted"), reason0.alias("reason"), no.alias("balance"))
    x = (x.where(known).withColumn("_valid", amount).withColumn("_q_u", F.coalesce(_units(F.col("quantity")), F.lit(0).cast("long")))
         .withColumn("_d_u", F.when(amount, F.when(F.col("type") == "in", F.col("_q_u")).otherwise(-F.col("_q_u")))
                     .otherwise(F.lit(0).cast("long"))))
    order = ["created_at", "id"]
    pos = F.struct("created_at", "id")
    x = prefix_sums(x, ["material_id"], order, {"_s_u": F.col("_d_u")}, cuts=block_cuts(adjustments, "created_at", "id"))
    # what follows reads the running sums three times
    x = written(x.withColumn("_b_u", F.col("_x0_u") + F.col("_s_u")), "adjustments")
    first_bad = x.where(F.col("_valid") & (F.col("_b_u") < 0)).groupBy("material_id").agg(
        F.min(pos).alias("_first_bad"), F.min_by(F.col("_b_u") - F.col("_d_u"), pos).alias("_start_u"))
    x = x.join(first_bad, "material_id", "left")
    before = F.col("_first_bad").isNull() | (pos < F.col("_first_bad"))
    quick = x.where(before).select(
        "id", "material_id", F.col("_valid").alias("accepted"),
        F.when(~F.col("_valid"), F.lit("bad_quantity")).otherwise(F.lit(None).cast("string")).alias("reason"),
        _to_money(F.col("_b_u")).alias("balance"))

    def init(r):
        return {"bal": r["_start_u"]}

    def step(s, r):
        reason = None
        if not r["_valid"]:
            reason = "bad_quantity"
        elif s["bal"] + r["_d_u"] < 0:
            reason = "insufficient_stock"
        else:
            s["bal"] += r["_d_u"]
        return {"id": r["id"], "material_id": r["material_id"], "accepted": reason is None, "reason": reason,
                "balance": s["bal"] / 10000}

    rest = x.where(~before).select("id", "material_id", "created_at", "_valid", "_d_u", "_start_u")
    slow = sorted_fold(rest, ["material_id"], order,
                       "id long, material_id long, accepted boolean, reason string, balance double", init, step)
    return quick.unionByName(slow).unionByName(nowhere)


def final_state(replayed: DataFrame, key: str, order: str = "id", value: str = "balance") -> DataFrame:
    """Last value per key of a replay (a partial aggregate: hot keys split)."""
    return replayed.groupBy(key).agg(F.max_by(value, order).alias(value))


# ----------------------------------------------------------------------------- I10
def sales_stock_moves(order_events: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """A change to ``delivered`` subtracts each line from product stock
    unless the order was already delivered or paid just before. Only status
    changes are considered here (the full life cycle with payments is I12).
    The status before each change is the previous change's status per order
    (the first change sees the order's stored status)."""
    ev = order_events.where(F.col("kind") == "set_status").select("seq", "order_id", "status", "ts")
    init = orders.select(F.col("id").alias("order_id"), F.col("status").alias("_init"))
    ev = previous_value(ev.join(init, "order_id"), ["order_id"], ["ts", "seq"], "status", "_prev",
                        cuts=block_cuts(order_events, "ts", "seq"))
    ev = ev.withColumn("_prev", F.when(F.col("_is_first"), F.col("_init")).otherwise(F.col("_prev")))
    hits = ev.where((F.col("status") == "delivered") & ~F.col("_prev").isin("delivered", "paid"))
    n = hits.groupBy("order_id").agg(F.count(F.lit(1)).alias("_times"))
    return items.join(n, "order_id").groupBy("product_id") \
        .agg(F.sum(F.col("quantity") * F.col("_times")).cast("long").alias("delivered"))


# ----------------------------------------------------------------------------- I11
def payments_replay(orders: DataFrame, attempts: DataFrame, strict: bool = False,
                    initial_paid: str | None = None, allowed: str | None = None, order: tuple[str, ...] = ("seq",),
                    cuts: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Payment attempts in sequence per order (by ``order``, whose last column is unique): a missing/zero amount, an
    unknown (or NULL) order or an amount above what remains is rejected (negative
    amounts pass); after each accepted payment status = paid if paid >= total else
    confirmed (which pulls a delivered or cancelled order back to confirmed). A
    NULL total counts as 0. ``strict=True`` also rejects negative amounts and
    payments on cancelled orders, and keeps a delivered order delivered until it
    is fully paid. ``allowed`` names a boolean column of ``attempts``: where it is
    false the attempt is rejected; ``keep`` names columns of ``attempts`` to pass on. Amounts in exact 1e-4 units; ``paid`` and
    ``status`` are NULL for an unknown order.

    Running sums, then repair (as in ``material_adjust_replay``): until an
    order's running total of valid payments first exceeds its total, every
    valid payment is accepted, so paid amounts and statuses are running sums
    (two-level scan); only the attempts from that point on are folded."""
    p0 = F.col(initial_paid) if initial_paid else F.lit(0.0)
    zero = F.lit(0).cast("long")
    o = orders.select(F.col("id").alias("order_id"), F.coalesce(_units(F.col("total_amount")), zero).alias("_t_u"),
                      F.col("status").alias("_st"), F.coalesce(_units(p0), zero).alias("_p0_u"), F.lit(True).alias("_known"))
    x = attempts.select("seq", *dict.fromkeys(c for c in (*order, *keep) if c != "seq"), "order_id", "amount",
                        *([F.col(allowed).alias("_may")] if allowed else [])).join(o, "order_id", "left")
    known = F.coalesce("_known", F.lit(False))
    nowhere = x.where(~known).select("seq", "order_id", F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("paid"),
                                     F.lit(None).cast("string").alias("status"), *keep)
    valid = F.col("amount").isNotNull() & (F.col("amount") != 0)
    if strict:
        valid = valid & (F.col("amount") > 0) & ~F.coalesce(F.col("_st") == "cancelled", F.lit(False)) if not allowed \
            else valid & (F.col("amount") > 0)
    if allowed:
        valid = valid & F.coalesce("_may", F.lit(False))
    x = x.where(known).withColumn("_valid", valid).withColumn("_a_u", F.coalesce(_units(F.col("amount")), zero))

    def status_after(paid: Column, n: Column) -> Column:
        part = F.when(F.col("_st") == "delivered", F.lit("delivered")).otherwise(F.lit("confirmed")) if strict else F.lit("confirmed")
        return F.when(n > 0, F.when(paid >= F.col("_t_u"), "paid").otherwise(part)).otherwise(F.col("_st"))

    pos = F.struct(*order)
    x = prefix_sums(x, ["order_id"], order, {"_p_u": F.when(F.col("_valid"), F.col("_a_u")).otherwise(zero),
                                               "_n": F.when(F.col("_valid"), 1).otherwise(0).cast("long")},
                    cuts=cuts if cuts is not None else block_cuts(attempts, *order[:2]))
    # what follows reads the running sums three times
    x = written(x.withColumn("_p_u", F.col("_p_u") + F.col("_p0_u")), "payments")
    bad = x.where(F.col("_valid") & (F.col("_p_u") > F.col("_t_u"))).groupBy("order_id").agg(
        F.min(pos).alias("_first_bad"), F.min_by(F.col("_p_u") - F.col("_a_u"), pos).alias("_start_u"),
        F.min_by(F.col("_n") - 1, pos).alias("_start_n"))
    x = x.join(bad, "order_id", "left")
    before = F.col("_first_bad").isNull() | (pos < F.col("_first_bad"))
    quick = x.where(before).select(
        "seq", "order_id", F.col("_valid").alias("accepted"), _to_money(F.col("_p_u")).alias("paid"),
        status_after(F.col("_p_u"), F.col("_n")).alias("status"), *keep)
    rest = x.where(~before).withColumn("_first", status_after(F.col("_start_u"), F.col("_start_n")))

    def init(r):
        return {"paid": r["_start_u"], "status": r["_first"]}

    def step(s, r):
        ok = r["_valid"] and r["_a_u"] <= r["_t_u"] - s["paid"]
        if ok:
            s["paid"] += r["_a_u"]
            if s["paid"] >= r["_t_u"]:
                s["status"] = "paid"
            elif not (strict and s["status"] == "delivered"):
                s["status"] = "confirmed"
        return {"seq": r["seq"], "order_id": r["order_id"], "accepted": bool(ok), "paid": s["paid"] / 10000,
                "status": s["status"], **{c: r[c] for c in keep}}

    kept = "".join(f", {c} {x.schema[c].dataType.simpleString()}" for c in keep)
    slow = sorted_fold(rest.select(*dict.fromkeys(("seq", *order, *keep)), "order_id", "_valid", "_a_u", "_t_u", "_start_u", "_first"),
                       ["order_id"], list(order), "seq long, order_id long, accepted boolean, paid double, status string" + kept, init, step)
    return quick.unionByName(slow).unionByName(nowhere)


# ----------------------------------------------------------------------------- I12
def order_lifecycle_replay(orders: DataFrame, events: DataFrame, deliveries: DataFrame | None = None,
                           strict: bool = False) -> DataFrame:
    """The full order life cycle per order, one output row per order.

    Event kinds: ``set_status`` (to ``delivered`` subtracts stock unless the
    order is delivered or paid), ``cancel``, ``payment`` (I11 rule),
    ``delivery_created`` (one per order; pending -> confirmed) and
    ``delivery_status`` (needs a delivery; ``delivered`` subtracts stock and
    sets delivered unless delivered/paid). ``stock_moves`` counts subtractions:
    it can reach 2 (delivered -> part payment -> confirmed -> delivered).
    ``strict=True`` subtracts stock at most once per order and applies the strict
    payment rule of ``payments_replay`` to the status of that moment.

    No per-order sequential pass. Payment acceptance is I11. Everything else follows from what stood
    before an event, in one scan (``plans.scan.carried``): the first ``delivery_created``, the last
    ``delivery_status`` to delivered, the last *reset* (set_status, cancel and full - in the plain mode
    all - accepted payments set the status whatever it was) and the last part payment. A place in an
    order's events is (ts, seq), so nothing is numbered and nothing is joined back: the rows of I11 are
    the payment events. The strict mode scans three times, as acceptance and delivery there depend on the status."""
    o = orders.select(F.col("id").alias("order_id"), F.col("status").alias("_s0"), "total_amount",
                      F.col("paid_amount").alias("_p0"))
    if deliveries is not None:
        o = o.join(deliveries.select("order_id").distinct().withColumn("_d0", F.lit(True)), "order_id", "left")
    o = o.withColumn("_d0", F.coalesce(F.col("_d0") if deliveries is not None else F.lit(False), F.lit(False)))
    order = ["ts", "seq"]
    x = events.select("seq", "order_id", "kind", "status", "amount", "ts").join(o, "order_id")
    cuts = block_cuts(events, "ts", "seq")
    k, st, at = F.col("kind"), F.col("status"), F.struct(*order)
    valued = lambda v: F.struct(at.alias("p"), v.alias("v"))
    created = ("first", F.when(k == "delivery_created", at))
    told = ("last", F.when((k == "delivery_status") & (st == "delivered"), at))

    def has_delivery(place: Column) -> Column:
        """Whether there was a delivery before ``place``."""
        return F.coalesce(F.col("_d0") | (F.col("_created") < place), F.lit(False))

    def since(place: Column, other: Column) -> Column:
        """``place`` is there and after ``other``, if that is there."""
        return place.isNotNull() & F.coalesce(place > other, F.lit(True))

    pays = x.where(k == "payment")
    if strict:
        # whether an order is cancelled does not depend on payments: only these three kinds decide it
        y = carried(x, ["order_id"], order, {"_created": created, "_told": told, "_set": (
            "last", F.when(k == "set_status", valued(st)).when(k == "cancel", valued(F.lit("cancelled"))))}, cuts)
        delivered = has_delivery(F.col("_told")) & since(F.col("_told"), F.col("_set.p"))
        live = F.when(delivered, "delivered").when(F.col("_set").isNull(), F.col("_s0")).otherwise(F.col("_set.v"))
        pays = y.where(k == "payment").withColumn("_live", ~F.coalesce(live == "cancelled", F.lit(False)))
    pays = payments_replay(o.select(F.col("order_id").alias("id"), "total_amount", F.col("_s0").alias("status"), "_p0"),
                           pays.select("seq", "ts", "order_id", "amount", "_s0", "_d0", *(["_live"] if strict else [])), strict=strict,
                           initial_paid="_p0", allowed="_live" if strict else None, order=("ts", "seq"), cuts=cuts, keep=("ts", "_s0", "_d0"))
    pays = pays.select("seq", "order_id", F.lit("payment").alias("kind"), F.lit(None).cast("string").alias("status"), "ts", "_s0", "_d0",
                       F.col("accepted").alias("_acc"), F.col("paid").alias("_paid"), (F.col("accepted") & (F.col("status") == "paid")).alias("_full"))
    x = x.where(k != "payment").select("seq", "order_id", "kind", "status", "ts", "_s0", "_d0").unionByName(pays, allowMissingColumns=True)
    reset = F.when(k == "set_status", valued(st)).when(k == "cancel", valued(F.lit("cancelled"))).when(F.col("_full"), valued(F.lit("paid")))
    part = F.when(F.col("_acc") & ~F.col("_full"), at)
    scan = {"_created": created, "_told": told, "_reset": ("last", reset if strict else reset.when(F.col("_acc"), valued(F.lit("confirmed"))))}
    if strict:
        scan["_part"] = ("last", part)
    # the scan reads its rows twice: the fold of the payments runs once
    x = carried(written(x, "life-cycle"), ["order_id"], order, scan, cuts)
    if strict:
        # a paid order that a part payment has reopened can be delivered; a delivered one stays so
        reopened = told[1].isNotNull() & has_delivery(at) & since(F.col("_part"), F.col("_reset.p"))
        scan["_told2"] = ("last", F.when(reopened, at))
        x = carried(x, ["order_id"], order, {"_told2": scan["_told2"]}, cuts)
    else:
        x = x.withColumns({c: F.lit(None).cast(x.schema["_created"].dataType) for c in ("_part", "_told2")})

    def status_now(place: Column | None) -> Column:
        """The status from the last reset and what has happened since, before ``place`` (None: at the end)."""
        r, rp, told_at, part_at = F.coalesce(F.col("_reset.v"), F.when(F.col("_reset").isNull(), F.col("_s0"))), F.col("_reset.p"), F.col("_told"), F.col("_part")
        told2 = since(F.col("_told2"), rp)
        made = F.col("_created").isNotNull() & ~F.col("_d0") & since(F.col("_created"), rp)
        if place is not None:
            made = made & (F.col("_created") < place)
        delivered = since(told_at, rp) & has_delivery(told_at)
        parted = since(part_at, rp)
        return (F.when(r == "delivered", r)
                .when(r == "paid", F.when(told2, "delivered").when(parted, "confirmed").otherwise(r))
                .when(delivered, "delivered").when(parted, "confirmed")
                .when(made & (r == "pending"), "confirmed").otherwise(r))

    settled = F.coalesce(status_now(at).isin("delivered", "paid"), F.lit(False))
    held = has_delivery(at)
    delivers = F.coalesce((st == "delivered") & ((k == "set_status") | ((k == "delivery_status") & held)), F.lit(False))
    refused = F.coalesce(((k == "payment") & ~F.col("_acc")) | ((k == "delivery_created") & held) | ((k == "delivery_status") & ~held), F.lit(False))
    # the state after the last event: what was carried to it, and the event itself
    own = {n: F.coalesce(*((F.col(n), c) if which == "first" else (c, F.col(n)))).alias(n) for n, (which, c) in scan.items()}
    g = x.select("order_id", "_s0", "_d0", at.alias("at"), F.when(F.col("_acc"), F.struct(at.alias("p"), "_paid")).alias("_pay"),
                 F.struct(*own.values(), *([] if strict else ["_part", "_told2"])).alias("end"), (delivers & ~settled).alias("_move"), refused.alias("_rej"))
    moves = F.count_if("_move")
    g = g.groupBy("order_id").agg(
        F.max_by(F.struct("_s0", "_d0", "end"), "at").alias("e"), F.max("_pay").alias("_pay"),
        (F.least(moves, F.lit(1).cast("long")) if strict else moves).alias("stock_moves"),
        F.count_if("_rej").alias("rejected"), F.count(F.lit(1)).alias("events"))
    g = g.join(o.select("order_id", "_p0"), "order_id").select("order_id", "e._s0", "e._d0", "e.end.*", "_pay", "_p0", "stock_moves", "rejected", "events")
    return g.select("order_id", status_now(None).alias("status"), F.coalesce(F.col("_pay._paid"), _to_money(_units(F.col("_p0"))), F.lit(0.0)).alias("paid"),
                    "stock_moves", "rejected", "events")


# ----------------------------------------------------------------------------- I13-I16
def customer_balances(payments: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Balance += payments for customers whose type is not retail (a NULL
    type is excluded too, as ``type != 'retail'`` is NULL)."""
    per = payments.join(orders.select(F.col("id").alias("order_id"), "customer_id"), "order_id") \
        .groupBy("customer_id").agg(msum("amount").alias("_pay"))
    c = customers.select(F.col("id").alias("customer_id"), "type", "balance")
    return c.join(per, "customer_id", "left").select(
        "customer_id", "type",
        (F.col("balance") + F.when(F.col("type") != "retail", F.coalesce("_pay", F.lit(0.0))).otherwise(0.0))
        .alias("balance"))


def return_restock(returns: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Approved returns put their quantity back (no repeat guard: with status
    ``events(id, status)`` every event that sets ``approved`` does so again)."""
    r = returns.where(F.col("product_id").isNotNull())
    if events is None:
        r = r.where(F.col("status") == "approved").withColumn("_times", F.lit(1))
    else:
        r = r.join(_times(events, "_rid", "approved"), F.col("id") == F.col("_rid"))
    return r.groupBy("product_id").agg(F.sum(F.col("quantity") * F.col("_times")).cast("long").alias("returned"))


def product_stock_rebuild(products: DataFrame, produced: DataFrame, delivered: DataFrame, returned: DataFrame,
                          opening: Column | None = None) -> DataFrame:
    """stock = opening + produced - delivered + returned, next to the
    stored stock. The three movement frames are unioned and summed once."""
    mv = (produced.select("product_id", F.col("produced").alias("q"), F.lit("produced").alias("k"))
          .unionByName(delivered.select("product_id", (-F.col("delivered")).alias("q"), F.lit("delivered").alias("k")))
          .unionByName(returned.select("product_id", F.col("returned").alias("q"), F.lit("returned").alias("k"))))
    per = mv.groupBy("product_id").agg(
        F.sum(F.when(F.col("k") == "produced", F.col("q")).otherwise(0)).alias("produced"),
        (-F.sum(F.when(F.col("k") == "delivered", F.col("q")).otherwise(0))).alias("delivered"),
        F.sum(F.when(F.col("k") == "returned", F.col("q")).otherwise(0)).alias("returned"),
        F.sum("q").alias("_net"))
    op = opening if opening is not None else F.lit(0)
    p = products.select(F.col("id").alias("product_id"), F.col("stock").alias("stored_stock"), op.alias("_open"))
    out = p.join(per, "product_id", "left")
    z = F.lit(0).cast("long")
    return out.select("product_id", F.coalesce("produced", z).alias("produced"),
                      F.coalesce("delivered", z).alias("delivered"), F.coalesce("returned", z).alias("returned"),
                      (F.col("_open") + F.coalesce("_net", z)).cast("long").alias("rebuilt_stock"), "stored_stock",
                      (F.col("stored_stock") - F.col("_open") - F.coalesce("_net", z)).cast("long").alias("difference"))


def equipment_rollup(e: DataFrame, ml: DataFrame) -> DataFrame:
    """I16: last/next maintenance come from the last *inserted* log (highest id),
    even when its performed date is older than another log's."""
    last = ml.groupBy("equipment_id").agg(F.max_by(F.struct("performed_date", "next_due"), "id").alias("_l"))
    x = e.join(last.withColumnRenamed("equipment_id", "id"), "id", "left")
    keep_last = F.col("last_maintenance") if "last_maintenance" in e.columns else F.lit(None).cast("date")
    return x.select(*[c for c in e.columns if c not in ("last_maintenance", "next_maintenance")],
                    F.when(F.col("_l").isNotNull(), F.col("_l.performed_date")).otherwise(keep_last)
                    .alias("last_maintenance"),
                    F.when(F.col("_l").isNotNull(), F.col("_l.next_due")).otherwise(F.col("next_maintenance"))
                    .alias("next_maintenance"))


# ----------------------------------------------------------------------------- I17
QC_MEASURES = ["ph", "tds", "turbidity", "chlorine", "bacteria_count", "color_value"]
# QC defaults for missing text fields.
QC_DEFAULT_TEXT = "ปกติ"
QC_DEFAULT_RESULT = "pending"


def qc_normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """0 -> NULL for the six measures (JS ``x || null``), odor/taste default
    text, result default pending; rows without a test date are rejected."""
    cols = []
    for c in raw.columns:
        if c in QC_MEASURES:
            cols.append(F.when(F.col(c) != 0, F.col(c)).alias(c))
        elif c in ("odor", "taste"):
            cols.append(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(QC_DEFAULT_TEXT)).alias(c))
        elif c == "result":
            cols.append(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(QC_DEFAULT_RESULT)).alias(c))
        else:
            cols.append(F.col(c))
    for c in ("odor", "taste"):
        if c not in raw.columns:
            cols.append(F.lit(QC_DEFAULT_TEXT).alias(c))
    x = raw.select(*cols)
    ok = F.col("test_date").isNotNull()
    return x.where(ok), x.where(~ok).withColumn("reason", F.lit("missing_test_date"))


# ----------------------------------------------------------------------------- I18
def js_number(x: Column) -> Column:
    """A JS-like number text: integers without ``.0``, no exponent (up to 10 places)."""
    s = x.cast("decimal(38,10)").cast("string")
    return F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))


def audit_events(production: DataFrame, qc: DataFrame, expenses: DataFrame, pos: DataFrame,
                 maintenance: DataFrame, returns: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """One ``create`` audit row per new production order, QC test, expense,
    purchase order, maintenance log and return, with the reference's detail text.
    (Deletes, payments and sales are not audited, as in the reference.) With
    ``users``, rows carry the creator's ``user_name``."""
    def part(df, entity, details):
        return df.select(F.col("created_by").cast("long").alias("user_id"), F.lit("create").alias("action"),
                         F.lit(entity).alias("entity"), F.col("id").alias("entity_id"), details.alias("details"),
                         F.col("created_at"))
    batch = lambda df: F.col("batch_number") if "batch_number" in df.columns else F.lit(None).cast("string")  # noqa
    rows = (part(production, "production", F.concat(F.lit("Batch: "), F.coalesce(batch(production), F.lit("undefined"))))
            .unionByName(part(qc, "qc", F.concat(F.lit("QC test batch "), F.coalesce(batch(qc), F.lit("undefined")))))
            .unionByName(part(expenses, "expense", F.concat(F.col("category"), F.lit(": "), js_number(F.col("amount")),
                                                              F.lit(" บาท"))))
            .unionByName(part(pos, "purchase_order", F.concat(F.lit("PO: "), F.col("po_number"))))
            .unionByName(part(maintenance, "maintenance", F.concat(F.lit("ซ่อมบำรุง: "), F.col("maintenance_type"))))
            .unionByName(part(returns, "return", F.concat(F.lit("คืนสินค้า: "), js_number(F.col("quantity")),
                                                          F.lit(" ชิ้น")))))
    if users is None:
        return rows
    return rows.join(users.select(F.col("id").cast("long").alias("user_id"), F.col("name").alias("user_name")), "user_id", "left")


# ----------------------------------------------------------------------------- I19 / I20 / A6
def settings_upsert(current: DataFrame | None, updates: DataFrame) -> DataFrame:
    """The last value per key wins (by ``seq``); ``updated_at`` is that change's time."""
    last = updates.groupBy("key").agg(F.max_by(F.struct("value", "updated_at"), "seq").alias("_l")) \
        .select("key", F.col("_l.value").alias("value"), F.col("_l.updated_at").alias("updated_at"))
    if current is None:
        return last
    return current.join(last.withColumnRenamed("value", "_nv").withColumnRenamed("updated_at", "_nu"), "key",
                        "full_outer").select("key", F.coalesce("_nv", "value").alias("value"),
                                             F.coalesce("_nu", "updated_at").alias("updated_at"))


def settings_map(settings: DataFrame) -> DataFrame:
    """key/value rows -> one map (settings are a small, bounded table)."""
    return settings.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


# Required fields and positivity per input kind.
INPUT_RULES = {
    "expense": (["category", "amount", "expense_date"], ["amount"]),
    "deposit": (["customer_id", "transaction_date"], []),
    "return": (["product_id", "quantity", "reason", "return_date"], []),
    "maintenance": (["equipment_id", "maintenance_type", "performed_date"], []),
    "route": (["route_name", "delivery_date"], []),
    "payment": (["order_id", "amount", "payment_date"], []),
    "delivery": (["order_id"], []),
    "bom": (["product_id", "material_id", "quantity_per_unit"], []),
    "material": (["code", "name", "unit"], []),
    "product": (["code", "name"], []),
    "production": (["product_id", "quantity_planned"], []),
    "customer": (["code", "name"], []),
    "user": (["username", "name"], []),
    "supplier": (["code", "name"], []),
    "purchase_order": (["supplier_id", "order_date"], []),
    "equipment": (["code", "name"], []),
}


def validate_inputs(df: DataFrame, kind: str, unique: list[str] | None = None, order_col: str = "id",
                    name: str | None = None) -> DataFrame:
    """First failing input rule per row -> ``reason`` (NULL = valid).

    Missing = NULL, empty text or 0 (JS falsiness); positivity as listed;
    ``unique`` columns (e.g. one delivery per order, one BOM line per pair)
    flag every row after the first of a duplicate group."""
    required, positive = INPUT_RULES[kind]
    reason = None
    for c in required:
        t = dict(df.dtypes)[c]
        miss = F.col(c).isNull()
        if t == "string":
            miss = miss | (F.col(c) == "")
        elif t in ("int", "bigint", "double", "float") or t.startswith("decimal"):
            miss = miss | (F.col(c) == 0)
        reason = F.when(miss, F.lit(f"missing_{c}")) if reason is None else reason.when(miss, F.lit(f"missing_{c}"))
    for c in positive:
        reason = reason.when(F.col(c) <= 0, F.lit(f"non_positive_{c}"))
    # the verdict column is ``reason`` unless the input already has one (returns do)
    name = name or ("reason" if "reason" not in df.columns else "invalid_reason")
    out = df.withColumn(name, reason)
    if unique:
        # first row per group = smallest ``order_col``: a partial aggregate + join,
        # so a hot group is pre-aggregated and the join is skew-split by AQE
        first = df.groupBy(*unique).agg(F.min(order_col).alias("_first"))
        out = out.join(first, unique, "left").withColumn(
            name, F.coalesce(name, F.when(F.col(order_col) > F.col("_first"),
                                          F.lit("duplicate_" + "_".join(unique))))).drop("_first")
    return out


def store_valid(df: DataFrame, kind: str, path: str, unique: list[str] | None = None, order_col: str = "id") -> dict[str, int]:
    """I20 as a load step: append the rows that pass ``validate_inputs`` to the Parquet table ``path``
    and return how many failed each rule, and ``accepted``. The counts are observed while the rows are
    written, so nothing is read for them a second time."""
    name = "_verdict"
    checked = validate_inputs(df, kind, unique, order_col, name)
    required, positive = INPUT_RULES[kind]
    reasons = [f"missing_{c}" for c in required] + [f"non_positive_{c}" for c in positive]
    reasons += ["duplicate_" + "_".join(unique)] if unique else []
    seen = Observation()
    counts = [F.count_if(F.col(name) == r).alias(r) for r in reasons] + [F.count_if(F.col(name).isNull()).alias("accepted")]
    checked.observe(seen, *counts).where(F.col(name).isNull()).drop(name).write.mode("append").parquet(path)
    return {k: n for k, n in seen.get.items() if n or k == "accepted"}
