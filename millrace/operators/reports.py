"""2D: aggregations (KPIs, period reports, profit, receivables, QC, deposits).

Shape rules used throughout:
* facts are aggregated to the grain of the join key *before* they meet a
  dimension (partial aggregation on the map side, one shuffle on the key);
* date filters are written as ranges on the stored column so they reach the
  Parquet scan (``order_date BETWEEN`` stays ``>= / <=``; ``DATE(ts) BETWEEN``
  becomes a half-open timestamp range);
* one conditional-aggregate pass per table replaces the reference's repeated
  scans; one-row results are combined by ``unionByName`` + ``max`` (no join).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import (MONEY, count_if, julian_days_between, margin_pct, mavg, month_range, msum,
                                        msum0, msum_dec)

OPEN = ("paid", "cancelled")  # statuses that close an order for receivables


def _d(x) -> Column:
    return F.to_date(F.lit(str(x))) if not isinstance(x, Column) else x


def _ts_day_range(col: str, date_from, date_to) -> Column:
    """``DATE(col) BETWEEN a AND b`` as a prunable half-open timestamp range."""
    lo = F.to_timestamp_ntz(F.lit(f"{date_from} 00:00:00"))
    hi = F.to_timestamp_ntz(F.lit(f"{dt.date.fromisoformat(str(date_to)) + dt.timedelta(days=1)} 00:00:00"))
    return (F.col(col) >= lo) & (F.col(col) < hi)


def _one_row(*frames: DataFrame) -> DataFrame:
    """Merge several one-row aggregate frames into one row without a join."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cols = [c for f in frames for c in f.columns]
    return u.agg(*[F.max(c).alias(c) for c in cols])


def _not_cancelled_in(o: DataFrame, date_from, date_to) -> DataFrame:
    return o.where((F.col("order_date") >= _d(date_from)) & (F.col("order_date") <= _d(date_to))
                   & (F.col("status") != "cancelled"))


# ----------------------------------------------------------------------------- D1
def dashboard_kpis(o: DataFrame, c: DataFrame, p: DataFrame, po: DataFrame, m: DataFrame, as_of) -> DataFrame:
    """The nine dashboard scalars, one conditional-aggregate pass per table."""
    day = _d(as_of)
    m_lo = F.trunc(day, "month")
    m_hi = F.add_months(m_lo, 1)
    live = F.col("status") != "cancelled"
    owed = F.when(~F.col("status").isin(*OPEN), F.col("total_amount") - F.col("paid_amount"))
    so = o.agg(
        msum0(F.when((F.col("order_date") == day) & live, F.col("total_amount")))
        .alias("today_sales"),
        msum0(F.when((F.col("order_date") >= m_lo) & (F.col("order_date") < m_hi) & live,
                                      F.col("total_amount"))).alias("month_sales"),
        count_if(F.col("status").isin("pending", "confirmed")).alias("pending_orders"),
        msum0(owed).alias("unpaid_amount"),
    )
    cu = c.agg(count_if(F.col("active") == 1).alias("total_customers"))
    pr = p.agg(count_if(F.col("active") == 1).alias("total_products"),
               count_if((F.col("stock") <= F.col("min_stock")) & (F.col("active") == 1)).alias("low_stock"))
    pp = po.agg(count_if(F.col("status").isin("pending", "in_progress")).alias("pending_production"))
    mm = m.agg(count_if(F.col("quantity") <= F.col("min_quantity")).alias("low_materials"))
    return _one_row(so, cu, pr, pp, mm)


# ----------------------------------------------------------------------------- D2
def sales_last_days(spark: SparkSession, o: DataFrame, as_of, n: int = 7) -> DataFrame:
    """Daily non-cancelled sales for the last ``n`` days, zero-filled."""
    day = _d(as_of)
    start = F.date_sub(day, n - 1)
    daily = (o.where((F.col("order_date") >= start) & (F.col("order_date") <= day) & (F.col("status") != "cancelled"))
             .groupBy(F.col("order_date").alias("date")).agg(msum("total_amount").alias("_t")))
    days = spark.range(1).select(F.explode(F.sequence(start, day)).alias("date"))
    return (F.broadcast(days).join(daily, "date", "left")
            .select("date", F.coalesce(F.col("_t"), F.lit(0.0)).alias("total")))


# ----------------------------------------------------------------------------- D3
def top_products(o: DataFrame, i: DataFrame, p: DataFrame, ym: str, k: int = 5) -> DataFrame:
    """D3: the month's products by quantity (top ``k``; ties by product id)."""
    lo, hi = month_range(ym)
    ords = o.where((F.col("order_date") >= lo) & (F.col("order_date") < hi) & (F.col("status") != "cancelled")) \
        .select(F.col("id").alias("order_id"))
    per = (i.join(ords, "order_id", "left_semi")
           .groupBy("product_id").agg(F.sum("quantity").alias("qty"), msum("subtotal").alias("_t")))
    out = per.join(p.select(F.col("id").alias("product_id"), "name"), "product_id")
    return (out.orderBy(F.desc("qty"), "product_id").limit(k)
            .select("product_id", "name", "qty", F.col("_t").alias("total")))


# ----------------------------------------------------------------------------- D4-D7
def sales_summary(o: DataFrame, date_from, date_to) -> DataFrame:
    """Count and sums over non-cancelled orders in the range (0 when empty)."""
    x = _not_cancelled_in(o, date_from, date_to)
    z = F.lit(0.0)
    return x.agg(F.count(F.lit(1)).alias("orders"),
                 msum0("total_amount").alias("revenue"),
                 msum0("paid_amount").alias("paid"),
                 msum0(F.col("total_amount") - F.col("paid_amount")).alias("unpaid"))


def sales_by_day(o: DataFrame, date_from, date_to) -> DataFrame:
    """Orders and revenue per order date (no zero-fill)."""
    x = _not_cancelled_in(o, date_from, date_to)
    return (x.groupBy(F.col("order_date").alias("date"))
            .agg(F.count(F.lit(1)).alias("orders"), msum("total_amount").alias("revenue")).orderBy("date"))


def _items_in(o: DataFrame, i: DataFrame, date_from, date_to) -> DataFrame:
    ords = _not_cancelled_in(o, date_from, date_to).select(F.col("id").alias("order_id"))
    return i.join(ords, "order_id", "left_semi")


def sales_by_product(o: DataFrame, i: DataFrame, p: DataFrame, date_from, date_to) -> DataFrame:
    """Quantity and revenue per product, revenue DESC."""
    per = (_items_in(o, i, date_from, date_to).groupBy("product_id")
           .agg(F.sum("quantity").alias("quantity"), msum("subtotal").alias("revenue")))
    return (per.join(p.select(F.col("id").alias("product_id"), "code", "name"), "product_id")
            .select("product_id", "code", "name", "quantity", "revenue").orderBy(F.desc("revenue"), "product_id"))


def sales_by_customer(o: DataFrame, c: DataFrame, date_from, date_to, k: int = 10) -> DataFrame:
    """Top ``k`` customers by revenue in the range."""
    per = (_not_cancelled_in(o, date_from, date_to).groupBy("customer_id")
           .agg(F.count("id").alias("orders"), msum("total_amount").alias("revenue")))
    out = per.join(c.select(F.col("id").alias("customer_id"), "code", "name"), "customer_id")
    return out.orderBy(F.desc("revenue"), "customer_id").limit(k) \
        .select("customer_id", "code", "name", "orders", "revenue")


# ----------------------------------------------------------------------------- D8
def inventory_valuation(p: DataFrame, m: DataFrame) -> DataFrame:
    """Stock value of active products and of materials, with item counts."""
    pv = p.where(F.col("active") == 1).agg(
        msum0(F.col("stock") * F.col("cost")).alias("product_value"),
        F.count(F.lit(1)).alias("product_items"))
    mv = m.agg(msum0(F.col("quantity") * F.col("cost_per_unit")).alias("material_value"),
               F.count(F.lit(1)).alias("material_items"))
    return _one_row(pv, mv)


def inventory_items(p: DataFrame) -> DataFrame:
    """Per-product stock value (active products, by code)."""
    return (p.where(F.col("active") == 1)
            .select("id", "code", "name", "stock", "cost", (F.col("stock") * F.col("cost")).alias("value"))
            .orderBy("code", "id"))


# ----------------------------------------------------------------------------- D9
def production_summary(po: DataFrame, date_from, date_to) -> DataFrame:
    """Production counts and sums by creation day (sums are NULL when empty)."""
    x = po.where(_ts_day_range("created_at", date_from, date_to))
    return x.agg(F.count(F.lit(1)).alias("total"), F.sum("quantity_planned").alias("planned"),
                 F.sum("quantity_produced").alias("produced"),
                 F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).cast("long").alias("completed"),
                 F.sum(F.when(F.col("status") == "cancelled", 1).otherwise(0)).cast("long").alias("cancelled"))


# ----------------------------------------------------------------------------- D10 / D11
def profit_by_product(o: DataFrame, i: DataFrame, p: DataFrame, date_from, date_to) -> DataFrame:
    """Quantity, revenue, cost at the *current* product cost, profit and margin.

    Items are cut to the period's live orders by a semi-join (no order columns
    travel) and summed per product *before* the product join, so the dimension
    meets one row per product, not one per line. Cost is a product attribute:
    ``sum(round4(qty * cost)) = round4(cost) * sum(qty)`` exactly (quantities are
    integers, costs carry at most 4 decimals), and profit = revenue - cost line by
    line or in total alike. Order discounts are ignored, as in the reference."""
    per = _items_in(o, i, date_from, date_to).groupBy("product_id").agg(
        F.sum("quantity").alias("qty"), msum_dec("subtotal").alias("_rev"))
    pc = p.select(F.col("id").alias("product_id"), "code", "name", F.col("cost").cast(MONEY).alias("_unit_cost"))
    j = per.join(pc, "product_id")
    cost = (F.col("_unit_cost") * F.col("qty")).cast("decimal(38,4)")
    return j.select("product_id", "code", "name", "qty", F.col("_rev").cast("double").alias("revenue"),
                    cost.cast("double").alias("cost"), (F.col("_rev") - cost).cast("double").alias("profit")) \
        .withColumn("margin_pct", margin_pct(F.col("profit"), F.col("revenue"))) \
        .orderBy(F.desc("profit"), "product_id")


def profit_total(by_product: DataFrame) -> DataFrame:
    """Totals over D10 plus the overall margin; ``chart_profit`` clamps at 0."""
    t = by_product.agg(msum("revenue").alias("_r"), msum("cost").alias("_c"), msum("profit").alias("_p"))
    z = F.lit(0.0)
    r, c, p = (F.coalesce(F.col(x), z) for x in ("_r", "_c", "_p"))
    return t.select(r.alias("revenue"), c.alias("cost"), p.alias("profit"),
                    margin_pct(p, r).alias("margin_pct"), F.greatest(p, z).alias("chart_profit"))


# ----------------------------------------------------------------------------- D12-D14
def expenses_in(e: DataFrame, date_from, date_to) -> DataFrame:
    return e.where((F.col("expense_date") >= _d(date_from)) & (F.col("expense_date") <= _d(date_to)))


def expenses_by_category(e: DataFrame, date_from, date_to, with_total: bool = True) -> DataFrame:
    """Total and count per category, total DESC; plus a grand-total row
    (``category`` NULL, ``is_total`` true, 0 when there are no expenses), which
    comes last and adds up the category rows: expenses are read once."""
    x = expenses_in(e, date_from, date_to)
    rows = x.groupBy("category").agg(msum("amount").alias("total"), F.count(F.lit(1)).alias("count")) \
        .withColumn("is_total", F.lit(False))
    if not with_total:
        return rows.orderBy(F.desc("total"), "category")
    tot = rows.agg(msum0("total").alias("total"), F.coalesce(F.sum("count"), F.lit(0)).alias("count")) \
        .select(F.lit(None).cast("string").alias("category"), "total", "count", F.lit(True).alias("is_total"))
    return rows.unionByName(tot).orderBy("is_total", F.desc("total"), "category")


def expenses_by_month(e: DataFrame, date_from, date_to) -> DataFrame:
    """Total per ``yyyy-MM``, ascending."""
    x = expenses_in(e, date_from, date_to)
    return x.groupBy(F.date_format("expense_date", "yyyy-MM").alias("month")) \
        .agg(msum("amount").alias("total")).orderBy("month")


def expense_month_cards(e: DataFrame, ym: str) -> DataFrame:
    """Month total, electricity, water, and everything else."""
    lo, hi = month_range(ym)
    x = e.where((F.col("expense_date") >= lo) & (F.col("expense_date") < hi))
    z = F.lit(0.0)

    def s(cond):
        return msum0(F.when(cond, F.col("amount")))
    cat = F.col("category")
    return x.agg(s(F.lit(True)).alias("total"), s(cat == "electricity").alias("electricity"),
                 s(cat == "water").alias("water"),
                 s(~cat.isin("electricity", "water") | cat.isNull()).alias("other"))


# ----------------------------------------------------------------------------- D15 / D16 / D26
def customer_outstanding(o: DataFrame) -> DataFrame:
    """Σ(total − paid) of open orders per customer."""
    return o.where(~F.col("status").isin(*OPEN)).groupBy("customer_id") \
        .agg(msum(F.col("total_amount") - F.col("paid_amount")).alias("outstanding"))


def receivables_by_customer(c: DataFrame, o: DataFrame) -> DataFrame:
    """Every active customer with its open balance (0 without orders), DESC."""
    owed = o.groupBy("customer_id").agg(msum(
        F.when(~F.col("status").isin(*OPEN), F.col("total_amount") - F.col("paid_amount")).otherwise(0.0)).alias("_o"))
    cc = c.where(F.col("active") == 1).select(F.col("id").alias("customer_id"), "code", "name", "phone",
                                              "credit_limit", "balance")
    return (cc.join(owed, "customer_id", "left")
            .select("customer_id", "code", "name", "phone", "credit_limit", "balance",
                    F.coalesce(F.col("_o"), F.lit(0.0)).alias("outstanding"))
            .orderBy(F.desc("outstanding"), "customer_id"))


def receivables_aging(o: DataFrame, c: DataFrame, as_of_ts, strict: bool = False) -> DataFrame:
    """Open amounts per customer in 0-30 / 31-60 / 61-90 / >90 day buckets.

    Age is fractional days since the due date. The reference's buckets leave
    gaps at (30, 31) and (60, 61); rows there land in ``unbucketed``. With
    ``strict=True`` the buckets are closed-open and the gaps disappear."""
    now = F.to_timestamp_ntz(F.lit(str(as_of_ts))) if not isinstance(as_of_ts, Column) else as_of_ts
    x = o.where(~F.col("status").isin(*OPEN) & F.col("due_date").isNotNull()).select(
        "customer_id", (F.col("total_amount") - F.col("paid_amount")).alias("amt"),
        julian_days_between(now, F.col("due_date").cast("timestamp_ntz")).alias("age"))
    age = F.col("age")
    if strict:
        b = [(age >= 0) & (age < 31), (age >= 31) & (age < 61), (age >= 61) & (age < 91), age >= 91]
    else:
        b = [age.between(0, 30), age.between(31, 60), age.between(61, 90), age > 90]
    gap = (age >= 0) & ~(b[0] | b[1] | b[2] | b[3])
    names = ["d30", "d60", "d90", "d90plus", "unbucketed"]
    per = x.groupBy("customer_id").agg(*[
        msum(F.when(cond, F.col("amt")).otherwise(0.0)).alias(n) for cond, n in zip(b + [gap], names)])
    return (per.join(c.select(F.col("id").alias("customer_id"), "name"), "customer_id")
            .select("customer_id", "name", *names).orderBy(F.desc("d90plus"), "customer_id"))


# ----------------------------------------------------------------------------- D17-D19
def qc_in(qt: DataFrame, date_from, date_to) -> DataFrame:
    return qt.where((F.col("test_date") >= _d(date_from)) & (F.col("test_date") <= _d(date_to)))


def qc_summary(qt: DataFrame, date_from, date_to) -> DataFrame:
    """Test count per result."""
    return qc_in(qt, date_from, date_to).groupBy("result").agg(F.count(F.lit(1)).alias("count"))


def qc_averages(qt: DataFrame, date_from, date_to) -> DataFrame:
    """Mean pH, TDS and turbidity (NULLs skipped)."""
    return qc_in(qt, date_from, date_to).agg(mavg("ph").alias("avg_ph"), mavg("tds").alias("avg_tds"),
                                             mavg("turbidity").alias("avg_turbidity"))


def qc_cards(qt: DataFrame) -> DataFrame:
    """Pass / fail / pending counts and mean pH over pH that is set and not 0."""
    r = F.col("result")
    return qt.agg(count_if(r == "pass").alias("pass_count"), count_if(r == "fail").alias("fail_count"),
                  count_if(r == "pending").alias("pending_count"),
                  mavg(F.when(F.col("ph") != 0, F.col("ph"))).alias("avg_ph"))


# ----------------------------------------------------------------------------- D20 / D21
def _deposit_totals(cd: DataFrame) -> DataFrame:
    return cd.groupBy("customer_id").agg(
        F.coalesce(F.sum("quantity_out"), F.lit(0)).alias("total_out"),
        F.coalesce(F.sum("quantity_returned"), F.lit(0)).alias("total_returned"),
        msum0("deposit_amount").alias("total_deposit"))


def deposits_by_customer(cd: DataFrame, c: DataFrame) -> DataFrame:
    """Containers out / returned / outstanding and deposit per customer."""
    per = _deposit_totals(cd).withColumn("outstanding", F.col("total_out") - F.col("total_returned"))
    return (per.join(c.select(F.col("id").alias("customer_id"), "name", "phone"), "customer_id")
            .select("customer_id", "name", "phone", "total_out", "total_returned", "outstanding", "total_deposit")
            .orderBy(F.desc("outstanding"), "customer_id"))


def deposits_totals(by_customer: DataFrame) -> DataFrame:
    """Grand totals over the per-customer rows."""
    t = by_customer.agg(F.coalesce(F.sum("total_out"), F.lit(0)).alias("total_out"),
                        F.coalesce(F.sum("total_returned"), F.lit(0)).alias("total_returned"))
    return t.withColumn("outstanding", F.col("total_out") - F.col("total_returned"))


def deposit_alerts(cd: DataFrame, c: DataFrame, min_out: int = 5, k: int = 5) -> DataFrame:
    """Customers holding more than ``min_out`` containers, top ``k``."""
    per = _deposit_totals(cd).withColumn("outstanding", F.col("total_out") - F.col("total_returned")) \
        .where(F.col("outstanding") > min_out)
    return (per.join(c.select(F.col("id").alias("customer_id"), "name"), "customer_id")
            .orderBy(F.desc("outstanding"), "customer_id").limit(k).select("customer_id", "name", "outstanding"))


# ----------------------------------------------------------------------------- D22-D25
def stock_level_counts(df: DataFrame, qty: str = "stock", min_col: str = "min_stock") -> DataFrame:
    """Total, ok (qty > min), low (0 < qty <= min), out (qty = 0)."""
    q, m = F.col(qty), F.col(min_col)
    return df.agg(F.count(F.lit(1)).alias("total"), count_if(q > m).alias("ok"),
                  count_if((q <= m) & (q > 0)).alias("low"), count_if(q == 0).alias("out"))


def po_cards(po: DataFrame) -> DataFrame:
    """Draft / approved / received counts and the total over all POs."""
    s = F.col("status")
    return po.agg(count_if(s == "draft").alias("draft"), count_if(s == "approved").alias("approved"),
                  count_if(s == "received").alias("received"),
                  msum0(F.coalesce("total_amount", F.lit(0.0))).alias("total_amount"))


def equipment_cards(e: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Total, active, in maintenance, and due within ``days`` (any status)."""
    s, nm = F.col("status"), F.col("next_maintenance")
    return e.agg(F.count(F.lit(1)).alias("total"), count_if(s == "active").alias("active"),
                 count_if(s == "maintenance").alias("maintenance"),
                 count_if(nm.isNotNull() & (nm <= F.date_add(_d(as_of), days))).alias("due"))


# The four kanban lanes, in display order.
KANBAN_LANES = ["pending", "in_progress", "completed", "cancelled"]


def production_kanban(spark: SparkSession, po: DataFrame) -> DataFrame:
    """The four lanes with their card count (0 kept). Cards themselves are
    ``kanban_cards`` (a flat frame): a lane can hold a quarter of all orders, so
    they are never collected into one row."""
    lanes = spark.createDataFrame([(i, s) for i, s in enumerate(KANBAN_LANES)], "lane_rank int, status string")
    cnt = po.groupBy("status").agg(F.count(F.lit(1)).alias("_n"))
    return (F.broadcast(lanes).join(cnt, "status", "left")
            .select("lane_rank", "status", F.coalesce("_n", F.lit(0)).cast("long").alias("count")).orderBy("lane_rank"))


def kanban_cards(po: DataFrame, p: DataFrame) -> DataFrame:
    """One card per production order in a lane, newest first within a lane."""
    rank = F.create_map(*[x for i, s in enumerate(KANBAN_LANES) for x in (F.lit(s), F.lit(i))])
    x = po.where(F.col("status").isin(*KANBAN_LANES)).join(
        p.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), "product_id", "left")
    return x.select(rank[F.col("status")].alias("lane_rank"), "status", "id", "product_id", "product_name",
                    "quantity_planned", "quantity_produced", "created_at") \
        .orderBy("lane_rank", F.desc("created_at"), F.desc("id"))


# ----------------------------------------------------------------------------- D27 / D28
def payments_total(pay: DataFrame, o: DataFrame) -> DataFrame:
    """Paid per order (0 without payments) and what remains."""
    paid = pay.groupBy("order_id").agg(msum("amount").alias("_p"))
    return (o.select(F.col("id").alias("order_id"), "total_amount").join(paid, "order_id", "left")
            .select("order_id", "total_amount", F.coalesce("_p", F.lit(0.0)).alias("paid"),
                    (F.col("total_amount") - F.coalesce("_p", F.lit(0.0))).alias("remaining")))


def max_id(df: DataFrame, col: str = "id") -> DataFrame:
    """``COALESCE(MAX(id), 0)``."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).cast("long").alias("max_id"))


def daily_count(df: DataFrame, as_of, ts_col: str = "created_at") -> DataFrame:
    """Non-cancelled rows created on the ``as_of`` day (batch-number input)."""
    return df.where(_ts_day_range(ts_col, as_of, as_of) & (F.col("status") != "cancelled")) \
        .agg(F.count(F.lit(1)).alias("count"))
