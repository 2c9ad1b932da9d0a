"""2C: list views and nested documents (all equi-joins on ids).

Join shapes: facts stay distributed; ``users`` (bounded, nation-sized) is
broadcast; growing dimensions (customers, products, suppliers, materials) are
left to AQE, which broadcasts them only when their measured size is under the
threshold. Nested documents aggregate each child table to the parent key
*separately* and only then join (never header x items x payments, which would
fan out). A document is one row per parent by definition; children are
collected per parent only (items of one order, lines of one PO), never per
status or per route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.filters import expenses_filter, sales_filter
from millrace.operators.reports import _ts_day_range
from millrace.plans.joins import with_user_name


def _cust(c: DataFrame, *cols: str) -> DataFrame:
    m = {"name": "customer_name", "phone": "customer_phone", "address": "customer_address"}
    return c.select(F.col("id").alias("customer_id"), *[F.col(x).alias(m.get(x, x)) for x in cols if x in c.columns])


def _prod(p: DataFrame, *cols: str) -> DataFrame:
    m = {"name": "product_name"}
    return p.select(F.col("id").alias("product_id"), *[F.col(x).alias(m.get(x, x)) for x in cols])


# ----------------------------------------------------------------------------- C1 / C2
def sales_list(o: DataFrame, c: DataFrame, u: DataFrame, status=None, date_from=None, date_to=None,
               customer_id=None) -> DataFrame:
    """Orders with customer name/phone and creator name, newest first."""
    x = sales_filter(o, status, date_from, date_to, customer_id)
    x = with_user_name(x.join(_cust(c, "name", "phone"), "customer_id"), u)
    return x.orderBy(F.desc("created_at"), F.desc("id"))


def recent_orders(o: DataFrame, c: DataFrame, k: int = 5) -> DataFrame:
    """Newest ``k`` orders with the customer name.

    The reference joins first, so an order whose customer is missing never
    takes one of the ``k`` places: the top-k runs over orders that have a
    customer (semi-join), and only the ``k`` winners fetch the name."""
    live = o.join(c.select(F.col("id").alias("customer_id")), "customer_id", "left_semi")
    top = live.orderBy(F.desc("created_at"), F.desc("id")).limit(k)
    return top.join(_cust(c, "name"), "customer_id").select(
        "id", "order_number", "customer_name", "total_amount", "status", "order_date", "created_at").orderBy(
        F.desc("created_at"), F.desc("id"))


# ----------------------------------------------------------------------------- C3
def sales_documents(o: DataFrame, c: DataFrame, items: DataFrame, p: DataFrame, pay: DataFrame, u: DataFrame,
                    d: DataFrame) -> DataFrame:
    """Per order the header, ``items[]`` (with product name and unit),
    ``payments[]`` by payment date (with the user name), the first delivery and
    the outstanding amount. Children are grouped per order before the joins."""
    it = items.join(_prod(p, "name", "unit"), "product_id", "left")
    line = F.struct("product_id", "product_name", "unit", "quantity", "unit_price", "subtotal")
    # collect_list gains nothing from map-side partial aggregation (it only
    # re-packs rows into arrays before the shuffle); shuffling the flat rows
    # by order first lets the arrays be built once, after the exchange
    item_arr = it.repartition("order_id").groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("product_id").alias("_k1"), F.col("subtotal").alias("_k2"),
                                             line.alias("v")))).alias("_items"))
    item_arr = item_arr.select("order_id", F.transform("_items", lambda s: s["v"]).alias("items"))
    pw = with_user_name(pay, u, "created_by", "by_name")
    pline = F.struct("id", "amount", "payment_date", "method", "by_name")
    pay_arr = pw.repartition("order_id").groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("payment_date").alias("_k1"), F.col("id").alias("_k2"),
                                             pline.alias("v")))).alias("_p"))
    pay_arr = pay_arr.select("order_id", F.transform("_p", lambda s: s["v"]).alias("payments"))
    first_del = d.groupBy("order_id").agg(F.min_by(F.struct("id", "driver_name", "delivery_date", "status"),
                                                   F.col("id")).alias("delivery"))
    hdr = o.join(_cust(c, "name", "phone", "address"), "customer_id")
    return (hdr.withColumnRenamed("id", "order_id")
            .join(item_arr, "order_id", "left").join(pay_arr, "order_id", "left").join(first_del, "order_id", "left")
            .withColumn("items", F.coalesce("items", F.array().cast("array<struct<product_id:bigint,product_name:string,"
                                                                       "unit:string,quantity:int,unit_price:double,"
                                                                       "subtotal:double>>")))
            .withColumn("outstanding", F.col("total_amount") - F.col("paid_amount")))


def document_summary(docs: DataFrame) -> DataFrame:
    """Flat projection of C3 documents: counts, sums and every nested field read back from the arrays."""
    pays = F.coalesce(F.col("payments"), F.array())

    def text(*cols):
        return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])

    def money(c, places=2):
        return c.cast(f"decimal(18,{places})")
    return docs.select(
        "order_id", "order_number", "customer_name", "total_amount", "outstanding",
        F.size("items").alias("item_count"),
        F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + x["quantity"]).alias("item_qty"),
        F.concat_ws("|", F.transform("items", lambda x: text(
            x["product_id"], x["product_name"], x["unit"], x["quantity"], money(x["subtotal"]),
            money(x["unit_price"] * x["quantity"])))).alias("item_keys"),
        F.size(pays).alias("payment_count"),
        F.concat_ws("|", F.transform(pays, lambda x: text(
            x["id"], money(x["amount"], 4), x["payment_date"], x["method"], x["by_name"]))).alias("payment_ids"),
        F.col("delivery.id").alias("delivery_id"), F.col("delivery.status").alias("delivery_status"),
        F.col("delivery.driver_name").alias("driver_name"), F.col("delivery.delivery_date").alias("delivery_date"))


# ----------------------------------------------------------------------------- C4 / C5
def production_list(po: DataFrame, p: DataFrame, u: DataFrame) -> DataFrame:
    """C4: production orders with product name/unit and creator, newest first."""
    x = with_user_name(po.join(_prod(p, "name", "unit"), "product_id"), u, "created_by", "by_name")
    return x.orderBy(F.desc("created_at"), F.desc("id"))


def production_report_rows(po: DataFrame, p: DataFrame, u: DataFrame, date_from, date_to) -> DataFrame:
    """C4 limited to ``DATE(created_at) BETWEEN from AND to`` (a prunable range)."""
    return production_list(po.where(_ts_day_range("created_at", date_from, date_to)), p, u)


# ----------------------------------------------------------------------------- C6 / C7 / C8
def deliveries_list(d: DataFrame, o: DataFrame, c: DataFrame) -> DataFrame:
    """Deliveries with order number/total and customer, by delivery date then creation."""
    oo = o.select(F.col("id").alias("order_id"), "order_number", "total_amount", "customer_id")
    x = d.join(oo, "order_id").join(_cust(c, "name", "address"), "customer_id").drop("customer_id")
    return x.orderBy(F.desc("delivery_date"), F.desc("created_at"), F.desc("id"))


def qc_list(qt: DataFrame, po: DataFrame, p: DataFrame, u: DataFrame) -> DataFrame:
    """Tests with the production order's batch number (NULL if unlinked; the
    test's own batch_number column is dropped, as the reference's later column
    wins), product name and tester name, newest first."""
    pob = po.select(F.col("id").alias("production_order_id"), "product_id",
                    (F.col("batch_number") if "batch_number" in po.columns else F.lit(None).cast("string"))
                    .alias("batch_number"))
    x = qt.drop("batch_number").join(pob, "production_order_id", "left") \
        .join(_prod(p, "name"), "product_id", "left").drop("product_id")
    return with_user_name(x, u).orderBy(F.desc("created_at"), F.desc("id"))


def bom_lines(bom: DataFrame, m: DataFrame, product_id=None) -> DataFrame:
    """BOM rows with material name, unit, unit cost and current stock."""
    if product_id is not None:
        bom = bom.where(F.col("product_id") == product_id)
    mm = m.select(F.col("id").alias("material_id"), F.col("name").alias("material_name"), "unit", "cost_per_unit",
                  F.col("quantity").alias("stock"))
    return bom.join(mm, "material_id")


# ----------------------------------------------------------------------------- C9 / C10
def purchase_orders_list(po: DataFrame, s: DataFrame, u: DataFrame) -> DataFrame:
    """POs with supplier name and creator, newest first."""
    ss = s.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    return with_user_name(po.join(ss, "supplier_id"), u).orderBy(F.desc("created_at"), F.desc("id"))


def purchase_documents(po: DataFrame, s: DataFrame, pi: DataFrame, m: DataFrame) -> DataFrame:
    """PO header with supplier and ``items[]`` (material name and unit)."""
    mm = m.select(F.col("id").alias("material_id"), F.col("name").alias("material_name"), "unit")
    line = F.struct("material_id", "material_name", "unit", "quantity", "unit_price", "subtotal")
    arr = pi.join(mm, "material_id", "left").repartition("po_id").groupBy("po_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("material_id").alias("_k1"), F.col("subtotal").alias("_k2"),
                                             line.alias("v")))).alias("_i"))
    arr = arr.select(F.col("po_id").alias("id"), F.transform("_i", lambda x: x["v"]).alias("items"))
    ss = s.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    return po.join(ss, "supplier_id").join(arr, "id", "left")


# ----------------------------------------------------------------------------- C11 / C12 / C13
def material_history(ml: DataFrame, u: DataFrame, material_id=None, k: int = 100) -> DataFrame:
    """C11: newest ``k`` logs per material with the user name.

    ``row_number() <= k`` over a window is planned with a per-partition group
    limit before the shuffle (Spark's window group-limit), so a hot material
    sends at most ``k`` rows per map task, not all of its rows."""
    if material_id is not None:
        ml = ml.where(F.col("material_id") == material_id)
    w = Window.partitionBy("material_id").orderBy(F.desc("created_at"), F.desc("id"))
    top = ml.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return with_user_name(top, u, "created_by", "by_name")


def maintenance_history(ml: DataFrame, u: DataFrame, equipment_id=None) -> DataFrame:
    """Maintenance logs with the user name, newest performed first."""
    if equipment_id is not None:
        ml = ml.where(F.col("equipment_id") == equipment_id)
    return with_user_name(ml, u, "created_by", "by_name").orderBy(F.desc("performed_date"), F.desc("id"))


def equipment_status(e: DataFrame, ml: DataFrame) -> DataFrame:
    """Each equipment with its log count (0 if none) and its latest log by
    performed date (ties: highest id) -- one group-by + join instead of N+1."""
    g = ml.groupBy("equipment_id").agg(
        F.count(F.lit(1)).alias("maintenance_count"),
        F.max_by(F.struct(F.col("id").alias("log_id"), "performed_date", "maintenance_type", "cost", "next_due"),
                 F.struct("performed_date", "id")).alias("last_log"))
    return (e.join(g.withColumnRenamed("equipment_id", "id"), "id", "left")
            .withColumn("maintenance_count", F.coalesce("maintenance_count", F.lit(0)).cast("long"))
            .orderBy("code", "id"))


# ----------------------------------------------------------------------------- C14-C18
def deposits_list(cd: DataFrame, c: DataFrame, u: DataFrame) -> DataFrame:
    """C14: container deposits with customer and creator, newest first."""
    x = with_user_name(cd.join(_cust(c, "name", "phone"), "customer_id"), u)
    return x.orderBy(F.desc("created_at"), F.desc("id"))


def returns_list(r: DataFrame, p: DataFrame, o: DataFrame, u: DataFrame) -> DataFrame:
    """Returns with product name, order number and creator (all LEFT joins)."""
    oo = o.select(F.col("id").alias("order_id"), "order_number")
    x = r.join(_prod(p, "name"), "product_id", "left").join(oo, "order_id", "left")
    return with_user_name(x, u).orderBy(F.desc("created_at"), F.desc("id"))


def routes_list(dr: DataFrame, dro: DataFrame, u: DataFrame) -> DataFrame:
    """Routes with creator and order count (pre-aggregated, 0 if none)."""
    cnt = dro.groupBy("route_id").agg(F.count(F.lit(1)).alias("order_count")).withColumnRenamed("route_id", "id")
    x = with_user_name(dr, u).join(cnt, "id", "left") \
        .withColumn("order_count", F.coalesce("order_count", F.lit(0)).cast("long"))
    return x.orderBy(F.desc("delivery_date"), F.desc("id"))


def route_documents(dr: DataFrame, dro: DataFrame, o: DataFrame, c: DataFrame) -> DataFrame:
    """C17: route stops: one row per (route, order) with order number, total,
    order status and customer, in sequence order. Kept flat: a route's order
    list grows with the data, so it is not collected into one row."""
    oo = o.select(F.col("id").alias("order_id"), "order_number", "total_amount",
                  F.col("status").alias("order_status"), "customer_id")
    stops = dro.join(oo, "order_id").join(_cust(c, "name", "address", "phone"), "customer_id").drop("customer_id")
    hdr = dr.select(F.col("id").alias("_rid"), "route_name", "delivery_date", F.col("status").alias("route_status"))
    return stops.join(hdr, stops["route_id"] == hdr["_rid"]).drop("_rid").orderBy("route_id", "sequence_number", "id")


def expenses_list(e: DataFrame, u: DataFrame, date_from=None, date_to=None, category=None) -> DataFrame:
    """Expenses with creator, by expense date then creation, newest first."""
    x = with_user_name(expenses_filter(e, date_from, date_to, category), u)
    return x.orderBy(F.desc("expense_date"), F.desc("created_at"), F.desc("id"))


# ----------------------------------------------------------------------------- C19 / F3
def union_status(o: DataFrame, statuses=("pending", "confirmed")) -> DataFrame:
    """the lists for each status concatenated (a bag union)."""
    parts = [o.where(F.col("status") == s) for s in statuses]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def orders_awaiting_delivery(o: DataFrame, d: DataFrame) -> DataFrame:
    """Pending or confirmed orders that have no delivery row (anti-join)."""
    return union_status(o).join(d.select("order_id").withColumnRenamed("order_id", "id"), "id", "left_anti")
