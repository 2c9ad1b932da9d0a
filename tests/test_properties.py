"""Property tests: folds vs plain Python loops, parts vs totals, stream vs batch."""

import datetime as dt
import os
import tempfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import reports as R
from millrace.operators import rules as I
from millrace.sources.bindings import Tables
from millrace.sources.tables import load_table
from millrace.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


TOTALS = {0: 100.0, 1: 100.0, 2: None}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 2, 9, None]), st.sampled_from([None, 0.0, -5.0, 10.0, 25.5, 40.0, 99.99])),
                min_size=1, max_size=40), st.booleans())
def test_payments_replay_equals_python_loop(spark, attempts, strict):
    """With NULL amounts, a NULL total, unknown and NULL orders; plain and strict."""
    stored = {0: "pending", 1: "delivered", 2: "cancelled"}
    orders = spark.createDataFrame([(k, stored[k], TOTALS[k]) for k in TOTALS], "id long, status string, total_amount double")
    att = spark.createDataFrame([(i, o, a) for i, (o, a) in enumerate(attempts)],
                                "seq long, order_id long, amount double")
    got = {r["seq"]: (r["accepted"], r["paid"], r["status"]) for r in I.payments_replay(orders, att, strict=strict).collect()}
    paid, status, want = dict.fromkeys(TOTALS, 0.0), dict(stored), {}
    for i, (o, a) in enumerate(attempts):
        if o not in TOTALS:
            want[i] = (False, None, None)
            continue
        total = TOTALS[o] or 0.0
        ok = bool(a) and a <= round(total - paid[o], 4) and not (strict and (a < 0 or status[o] == "cancelled"))
        if ok:
            paid[o] = round(paid[o] + a, 4)
            if paid[o] >= total:
                status[o] = "paid"
            elif not (strict and status[o] == "delivered"):
                status[o] = "confirmed"
        want[i] = (ok, paid[o], status[o])
    assert got == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 2, 3, 8, None]), st.sampled_from(["in", "out"]),
                          st.sampled_from([None, 0.0, 1.5, 7.0, 30.0])), min_size=1, max_size=40))
def test_adjust_replay_equals_python_loop(spark, moves):
    """With NULL quantities, unknown and NULL materials, and a NULL opening stock."""
    start = {0: 10.0, 1: 10.0, 2: 10.0, 3: None}
    init = spark.createDataFrame(list(start.items()), "id long, quantity double")
    adj = spark.createDataFrame([(i, m, t, q, T0 + dt.timedelta(seconds=i)) for i, (m, t, q) in enumerate(moves)],
                                "id long, material_id long, type string, quantity double, created_at timestamp_ntz")
    got = {r["id"]: (r["accepted"], r["reason"], r["balance"]) for r in I.material_adjust_replay(init, adj).collect()}
    bal, want = {k: v or 0.0 for k, v in start.items()}, {}
    for i, (m, t, q) in enumerate(moves):
        reason = "bad_quantity" if not q or q <= 0 else "unknown_material" if m not in bal else None
        if reason is None:
            nb = bal[m] + (q if t == "in" else -q)
            if nb < 0:
                reason = "insufficient_stock"
            else:
                bal[m] = nb
        want[i] = (reason is None, reason, bal.get(m))
    assert got == want


def test_expense_parts_sum_to_total(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = R.expenses_by_category(t.expenses, "2024-01-01", "2024-01-31").collect()
    parts = sum(r["total"] for r in rows if not r["is_total"])
    total = [r["total"] for r in rows if r["is_total"]][0]
    assert abs(parts - total) < 1e-6
    assert sum(r["count"] for r in rows if not r["is_total"]) == [r["count"] for r in rows if r["is_total"]][0]


def test_stream_daily_sales_equals_batch(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = {r["day"]: (r["orders"], r["revenue"]) for r in J.run_daily_sales(spark, sf_dir).collect()}
    b = {r["date"]: (r["orders"], r["revenue"]) for r in
         R.sales_by_day(t.sales_orders.withColumn("order_date", F.to_date("created_at")), "1990-01-01", "2030-01-01")
         .collect()}
    assert s == b


def test_stream_ledger_over_several_batches_equals_batch(spark, sf_dir):
    """Events split into three time-ordered files, one micro-batch each: the
    keyed state carries across batches and ends where the batch replay ends."""
    ev = load_table(spark, sf_dir, "events")
    d = tempfile.mkdtemp(prefix="j2-", dir="/tmp")
    bounds = [None, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20), None]
    for i in range(3):
        part = ev
        if bounds[i] is not None:
            part = part.where(F.col("ts") >= F.lit(bounds[i]))
        if bounds[i + 1] is not None:
            part = part.where(F.col("ts") < F.lit(bounds[i + 1]))
        part.coalesce(1).write.mode("append").parquet(os.path.join(d, "events.parquet"))
    t = Tables(spark, sf_dir)
    streamed = {r["id"]: (r["accepted"], r["balance"]) for r in
                J.run_material_ledger(spark, d, t.raw_materials, "reject", max_files=1).collect()}
    batch = {r["id"]: (r["accepted"], r["balance"]) for r in
             I.material_adjust_replay(t.raw_materials, t.material_logs).collect()}
    assert streamed == batch


def test_stream_daily_sales_append_mode_emits_closed_windows_only(spark, sf_dir):
    upd = {r["day"]: r["orders"] for r in J.run_daily_sales(spark, sf_dir, "1 day", "update").collect()}
    app = {r["day"]: r["orders"] for r in J.run_daily_sales(spark, sf_dir, "1 day", "append").collect()}
    assert app and set(app) < set(upd)
    assert all(app[d] == upd[d] for d in app)
    assert max(app) < max(upd)


def plain_lifecycle(orders, deliveries, rows, strict):
    """The I12 rules one event after the other."""
    state = {}
    for seq, o, kind, status, amount, ts in sorted(rows, key=lambda r: (r[5], r[0])):
        if o not in orders:
            continue
        s = state.setdefault(o, {"status": orders[o][0], "total": orders[o][1] or 0.0, "paid": orders[o][2], "del": o in deliveries,
                                 "moves": 0, "rejected": 0, "events": 0})
        s["events"] += 1
        if kind == "set_status":
            s["moves"] += status == "delivered" and s["status"] not in ("delivered", "paid")
            s["status"] = status
        elif kind == "cancel":
            s["status"] = "cancelled"
        elif kind == "payment":
            if not amount or amount > s["total"] - s["paid"] or (strict and (amount < 0 or s["status"] == "cancelled")):
                s["rejected"] += 1
            else:
                s["paid"] += amount
                if s["paid"] >= s["total"]:
                    s["status"] = "paid"
                elif not (strict and s["status"] == "delivered"):
                    s["status"] = "confirmed"
        elif kind == "delivery_created":
            if s["del"]:
                s["rejected"] += 1
            else:
                s["del"] = True
                if s["status"] == "pending":
                    s["status"] = "confirmed"
        elif not s["del"]:
            s["rejected"] += 1
        elif status == "delivered" and s["status"] not in ("delivered", "paid"):
            s["moves"] += 1
            s["status"] = "delivered"
    return {(o, s["status"], s["paid"], min(s["moves"], 1) if strict else s["moves"], s["rejected"], s["events"])
            for o, s in state.items()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3),
                          st.sampled_from(["set_status:confirmed", "set_status:delivered", "set_status:pending", "set_status:paid",
                                           "set_status:cancelled", "cancel", "payment:40", "payment:70", "payment:0", "payment:-10",
                                           "delivery_created", "delivery_status:delivered", "delivery_status:delivered",
                                           "delivery_status:in_transit"]), st.integers(0, 20)),
                min_size=1, max_size=40), st.booleans())
def test_order_lifecycle_equals_python_loop(spark, evs, strict):
    """Events arrive in any order of time; the time decides."""
    stored = {0: ("pending", 100.0, 0.0), 1: ("delivered", 100.0, 50.0), 2: ("paid", 80.0, 80.0)}
    orders = spark.createDataFrame([(k, *v) for k, v in stored.items()],
                                   "id long, status string, total_amount double, paid_amount double")
    deliveries = spark.createDataFrame([(1,)], "order_id long")
    rows = []
    for i, (o, e, minute) in enumerate(evs):
        kind, _, arg = e.partition(":")
        status = arg if kind in ("set_status", "delivery_status") else None
        amount = float(arg) if kind == "payment" else None
        rows.append((i, o, kind, status, amount, T0 + dt.timedelta(minutes=minute)))
    ev = spark.createDataFrame(rows, "seq long, order_id long, kind string, status string, amount double, "
                                     "ts timestamp_ntz")
    got = {tuple(r) for r in I.order_lifecycle_replay(orders, ev, deliveries, strict=strict).collect()}
    assert got == plain_lifecycle(stored, {1}, rows, strict)


def test_stream_activity_feed_over_several_batches_equals_batch(spark, sf_dir):
    """Orders and events split into two files each, one file per micro-batch:
    the persisted per-source top-k carries across batches."""
    from millrace.operators.feeds import activity_feed
    d = tempfile.mkdtemp(prefix="j4-", dir="/tmp")
    for name, key in [("orders", "o_orderkey"), ("events", "event_id")]:
        df = load_table(spark, sf_dir, name)
        for part in (df.where(F.col(key) % 2 == 0), df.where(F.col(key) % 2 == 1)):
            part.coalesce(1).write.mode("append").parquet(os.path.join(d, f"{name}.parquet"))
    t = Tables(spark, sf_dir)
    streamed = J.run_activity_feed(spark, d, t, 12, max_files=1).collect()
    batch = activity_feed(t.sales_orders, t.customers, t.material_logs, t.raw_materials, t.production_orders,
                          t.products, 12).collect()
    assert [tuple(r) for r in streamed] == [tuple(r) for r in batch]


def test_stream_daily_sales_drops_rows_later_than_the_watermark(spark, sf_dir):
    """Orders arrive newest first, in three files (one micro-batch each). Spark
    filters late rows with the watermark as it stood one batch earlier: the
    second batch (middle file) is still counted, the third (oldest) dropped."""
    import time
    d = tempfile.mkdtemp(prefix="j1-", dir="/tmp")
    orders = load_table(spark, sf_dir, "orders")
    c1, c2 = dt.datetime(2000, 1, 1), dt.datetime(1998, 1, 1)
    for cond in [F.col("o_orderdate") >= F.lit(c1), (F.col("o_orderdate") >= F.lit(c2)) & (F.col("o_orderdate") < F.lit(c1)),
                 F.col("o_orderdate") < F.lit(c2)]:
        orders.where(cond).coalesce(1).write.mode("append").parquet(f"{d}/orders.parquet")
        time.sleep(1.1)  # file order = modification order
    got = {r["day"]: (r["orders"], r["revenue"]) for r in J.run_daily_sales(spark, d, "1 day", max_files=1).collect()}
    t = Tables(spark, sf_dir)
    kept = t.sales_orders.where(F.col("created_at") >= F.lit(c2))
    want = {r["date"]: (r["orders"], r["revenue"]) for r in
            R.sales_by_day(kept.withColumn("order_date", F.to_date("created_at")), "1990-01-01", "2030-01-01").collect()}
    assert got == want
