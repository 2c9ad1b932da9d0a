"""Streaming jobs that stop and resume: the end result is the batch result."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import reports as R
from millrace.operators import rules as I
from millrace.operators.feeds import activity_feed
from millrace.session import ship_package
from millrace.sources.bindings import Tables
from millrace.sources.tables import load_table
from millrace.streaming import jobs as J
from millrace.streaming.ledger import ledger_stream, use_state_store


def _append(spark, sf_dir, d, name, cond):
    load_table(spark, sf_dir, name).where(cond).coalesce(1).write.mode("append").parquet(os.path.join(d, f"{name}.parquet"))


def test_ledger_resumes_where_it_stopped(spark, sf_dir):
    d, job = tempfile.mkdtemp(prefix="j2-", dir="/tmp"), tempfile.mkdtemp(prefix="job-", dir="/tmp")
    t = Tables(spark, sf_dir)
    cut = F.lit(dt.datetime(2024, 1, 15))
    _append(spark, sf_dir, d, "events", F.col("ts") < cut)
    first = J.run_material_ledger(spark, d, t.raw_materials, "reject", job=job).count()
    _append(spark, sf_dir, d, "events", F.col("ts") >= cut)
    rows = J.run_material_ledger(spark, d, t.raw_materials, "reject", job=job)
    want = {(r["id"], r["accepted"], r["reason"], r["balance"]) for r in I.material_adjust_replay(t.raw_materials, t.material_logs).collect()}
    assert 0 < first < len(want)
    assert {(r["id"], r["accepted"], r["reason"], r["balance"]) for r in rows.collect()} == want
    assert J.run_material_ledger(spark, d, t.raw_materials, "reject", job=job).count() == len(want)  # nothing new: nothing changes


def _moves(spark, folder, rows):
    """One more file of moves."""
    df = spark.createDataFrame(rows, "id long, material_id long, type string, quantity double, created_at timestamp_ntz")
    df.coalesce(1).write.mode("append").parquet(folder)


def _ledger(spark, folder, job, materials, mode="reject"):
    """The job of ``run_material_ledger`` over a folder of plain moves."""
    use_state_store(spark)
    stream = spark.readStream.schema("id long, material_id long, type string, quantity double, created_at timestamp_ntz").parquet(folder)
    q = ledger_stream(stream, materials, mode).writeStream.option("checkpointLocation", f"{job}/chk").format("parquet") \
        .option("path", f"{job}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {r.id: (r.material_id, r.accepted, r.reason, r.balance, r.alert) for r in spark.read.parquet(f"{job}/out").collect()}
    state = sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"])
    return rows, state


@pytest.mark.parametrize("mode", ["reject", "clamp"])
def test_ledger_state_over_batches(spark, mode):
    """Rules, alerts, the minimum of the batch's time, unknown and NULL materials; only touched keys are written."""
    ship_package(spark)
    d, job = tempfile.mkdtemp(prefix="j2-", dir="/tmp"), tempfile.mkdtemp(prefix="job-", dir="/tmp")
    rnd = random.Random(6)
    opening = {k: rnd.randrange(20) for k in range(40)}
    held, seen = dict(opening), 0
    for n, keys in enumerate([range(40), [3], [3, 5, 99, None]]):
        minimum = {k: 4.0 if n else None for k in opening}
        rows, want = [], {}
        for k in keys:
            for j in range(6):
                seen += 1
                rows.append((seen, k, rnd.choice(["in", "out", "out", "use"]), rnd.choice([1.0, 2.5, 7.0, 0.0, -1.0, None]), dt.datetime(2024, 1, 1 + n, 12 - j)))
        for i, k, kind, q, _ in sorted(rows, key=lambda r: (r[4], r[0])):
            b, d_ = held.get(k, 0), (q or 0.0) * (1 if kind == "in" else -1)
            if mode == "clamp":
                a, reason = (b + d_ if d_ > 0 else max(0, b + d_)), None
            else:
                reason = "bad_quantity" if not q or q <= 0 else "unknown_material" if k not in opening else "insufficient_stock" if b + d_ < 0 else None
                a = b if reason else b + d_
            held[k] = a
            m = minimum.get(k)
            alert = "out" if a == 0 != b else "low" if m is not None and a <= m < b else None
            none = mode == "reject" and k not in opening
            want[i] = (k, reason is None, reason, None if none else a, None if none else alert)
        _moves(spark, d, rows)
        got, written = _ledger(spark, d, job, spark.createDataFrame([(k, float(q), minimum[k]) for k, q in opening.items()],
                                                                    "id long, quantity double, min_quantity double"), mode)
        assert {i: got[i] for i in want} == want and len(got) == seen
        assert written <= 3 * len(keys)


def test_feed_resumes_and_fails_without_its_state(spark, sf_dir):
    d, job = tempfile.mkdtemp(prefix="j4-", dir="/tmp"), tempfile.mkdtemp(prefix="job-", dir="/tmp")
    t = Tables(spark, sf_dir)
    halves = [("orders", "o_orderkey"), ("events", "event_id")]
    for name, key in halves:
        _append(spark, sf_dir, d, name, F.col(key) % 2 == 0)
    J.run_activity_feed(spark, d, t, 12, job=job)
    for name, key in halves:
        _append(spark, sf_dir, d, name, F.col(key) % 2 == 1)
    got = J.run_activity_feed(spark, d, t, 12, job=job).collect()
    want = activity_feed(t.sales_orders, t.customers, t.material_logs, t.raw_materials, t.production_orders, t.products, 12).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    kept = os.listdir(f"{job}/top")
    assert len(kept) <= 2
    os.rename(f"{job}/top", f"{job}/elsewhere")
    load_table(spark, sf_dir, "orders").limit(3).coalesce(1).write.mode("append").parquet(f"{d}/orders.parquet")
    with pytest.raises(Exception, match="state of this job is missing"):
        J.run_activity_feed(spark, d, t, 12, job=job)


def test_daily_sales_over_two_runs_equals_batch(spark, sf_dir):
    d, job = tempfile.mkdtemp(prefix="j1-", dir="/tmp"), tempfile.mkdtemp(prefix="job-", dir="/tmp")
    cut = F.lit(dt.datetime(1998, 6, 1))
    _append(spark, sf_dir, d, "orders", F.col("o_orderdate") < cut)
    J.run_daily_sales(spark, d, "1 day", job=job)
    _append(spark, sf_dir, d, "orders", F.col("o_orderdate") >= cut)
    got = {r["day"]: (r["orders"], r["revenue"]) for r in J.run_daily_sales(spark, d, "1 day", job=job).collect()}
    t = Tables(spark, sf_dir)
    want = {r["date"]: (r["orders"], r["revenue"]) for r in R.sales_by_day(
        t.sales_orders.withColumn("order_date", F.to_date("created_at")), "1990-01-01", "2030-01-01").collect()}
    assert got == want


def test_dedupe_over_several_batches(spark, sf_dir):
    d = tempfile.mkdtemp(prefix="j5-", dir="/tmp")
    cuts = [dt.datetime(2023, 1, 1), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20), dt.datetime(2030, 1, 1)]
    for a, b in zip(cuts, cuts[1:]):
        _append(spark, sf_dir, d, "events", (F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
    kept = J.run_dedupe(spark, d, "1 hour", max_files=1)
    every = Tables(spark, sf_dir).order_events
    cols = ["order_id", "kind", "status"]
    assert {tuple(r) for r in kept.select(*cols).collect()} == {tuple(r) for r in every.select(*cols).collect()}
    assert every.select(*cols).distinct().count() <= kept.count() <= every.count()
    assert kept.groupBy("seq").count().where("count > 1").count() == 0
