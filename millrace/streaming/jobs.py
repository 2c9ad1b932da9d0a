"""2J: Structured Streaming versions of the batch rules.

The reference only polls (its dashboard reloads every five minutes); a Spark
user writes the same rules as streaming queries:

* J1 daily sales: event-time tumbling windows with a watermark;
* J2/J3 stock ledger and alerts: keyed state of Spark's state store (``ledger``);
* J4 activity feed: every micro-batch is merged into a small top-k;
* J5 duplicate status events: ``dropDuplicatesWithinWatermark``.

A job lives in a folder: ``job`` names it (a path, or a name below the shared
folder of ``spark.checkpoint.dir``). Run again with the same ``job``, it resumes
where it stopped; without one, a run gets a fresh folder. Windows, balances and
seen events are Spark's own state. Only the feed's thirteen rows are a numbered
snapshot: batch n reads snapshot n - 1 and fails if it is missing, writes
snapshot n (again, if the batch is repeated), and removes those that no
repetition can need.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.functions.scalars import label, msum
from millrace.session import ensure_checkpoint_dir, ship_package
from millrace.sources.bindings import BINDINGS
from millrace.sources.tables import SCHEMAS, table_path
from millrace.streaming.ledger import LEDGER_SCHEMA, ledger_stream, use_state_store


def _path(spark: SparkSession, path: str):
    """(file system, path) of the session's storage, local or remote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A table folder as a file stream (new Parquet files in it = new data).

    A table stored as one file is streamed from its folder with a file-name
    filter instead."""
    path = table_path(sf_dir, name)
    r = spark.readStream.schema(SCHEMAS[name])
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    fs, p = _path(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return r.option("pathGlobFilter", f"{name}.parquet").parquet(p.getParent().toString())
    return r.parquet(path)


def stream_binding(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A plain-projection binding over a streaming source (same SQL as batch)."""
    b = BINDINGS[name]
    df = stream_table(spark, sf_dir, b.source, max_files)
    if b.where:
        df = df.where(b.where)
    return df.selectExpr(*b.exprs)


def run_dir(spark: SparkSession, name: str, job: str | None = None) -> str:
    """The folder of a job: the path ``job``, the folder of that name below the shared checkpoint
    folder, or without a name a fresh one."""
    if job and "/" in job:
        return job.rstrip("/")
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{job or f'{name}-{uuid.uuid4().hex[:12]}'}"


def snapshot_sink(spark: SparkSession, folder: str, merge: Callable[[DataFrame | None, DataFrame, int], DataFrame]):
    """foreachBatch sink: snapshot n = ``merge(snapshot n - 1, batch, n)``; the first batch gets None."""
    def write(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        fs, before = _path(s, f"{folder}/{n - 1}")
        if n > 0 and not fs.exists(before):
            raise RuntimeError(f"the state of this job is missing: {folder}/{n - 1}")
        prev = s.read.parquet(f"{folder}/{n - 1}") if n > 0 else None
        merge(prev, batch, n).write.mode("overwrite").parquet(f"{folder}/{n}")
        if n > 1:  # batch n can be repeated and then reads snapshot n - 1; older ones are done with
            fs.delete(_path(s, f"{folder}/{n - 2}")[1], True)
    return write


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest snapshot of a job."""
    fs, p = _path(spark, folder)
    if not fs.exists(p):
        raise RuntimeError(f"no batch has run yet: {folder}")
    return spark.read.parquet(f"{folder}/{max(int(f.getPath().getName()) for f in fs.listStatus(p))}")


def _run(stream: DataFrame, folder: str, sink) -> None:
    stream.writeStream.option("checkpointLocation", f"{folder}/chk").foreachBatch(sink).outputMode("update") \
        .trigger(availableNow=True).start().awaitTermination()


# ----------------------------------------------------------------------------- J1
def daily_sales_stream(orders: DataFrame, delay: str = "1 day") -> DataFrame:
    """Non-cancelled revenue and order count per UTC day of ``created_at``;
    rows later than ``delay`` behind the newest event are dropped (Spark
    applies the watermark to late rows one micro-batch later, so a row is
    dropped once a *previous* batch has moved the watermark past it)."""
    x = orders.where(F.col("status") != "cancelled").withColumn("_et", F.col("created_at").cast("timestamp"))
    return (x.withWatermark("_et", delay).groupBy(F.window("_et", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("orders"), msum("total_amount").alias("revenue"))
            .select(F.to_date(F.col("w.start")).alias("day"), "orders", "revenue"))


def run_daily_sales(spark: SparkSession, sf_dir: str, delay: str = "1 day", mode: str = "update",
                    max_files: int | None = None, job: str | None = None) -> DataFrame:
    """Run J1 to the end of the available data and read the result.

    ``mode='update'`` emits every window as it changes into a folder of the batch's
    number (a repeated batch replaces it), and the newest row of a day counts, so a
    batch writes its own days only; ``mode='append'`` emits a window once, after the
    watermark passes its end, into a plain file sink - so the newest windows,
    still open when the data ends, are not in the output yet."""
    d = run_dir(spark, "j1", job)
    stream = daily_sales_stream(stream_binding(spark, sf_dir, "sales_orders", max_files), delay)
    if mode == "append":
        stream.writeStream.option("checkpointLocation", f"{d}/chk").trigger(availableNow=True).outputMode("append") \
            .format("parquet").option("path", f"{d}/out").start().awaitTermination()
        return spark.read.parquet(f"{d}/out")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{d}/days/batch={n}")

    _run(stream, d, write)
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(f"{d}/days")
    newest = rows.groupBy("day").agg(F.max_by(F.struct("orders", "revenue"), "batch").alias("r"))
    return newest.select("day", "r.orders", "r.revenue")


# ----------------------------------------------------------------------------- J2 / J3
def run_material_ledger(spark: SparkSession, sf_dir: str, initial: DataFrame, mode: str = "reject",
                        max_files: int | None = None, job: str | None = None) -> DataFrame:
    """Run J2 over the material-log stream and read back all emitted rows: ``mode='reject'`` is the
    manual adjustment rule (I9), ``'clamp'`` the production-use rule (I8). Balances are the stream's
    keyed state, so a batch costs what its materials cost; the file sink takes each batch once."""
    ship_package(spark)
    use_state_store(spark)
    d = run_dir(spark, "j2", job)
    rows = ledger_stream(stream_binding(spark, sf_dir, "material_logs", max_files), initial, mode)
    rows.writeStream.option("checkpointLocation", f"{d}/chk").format("parquet").option("path", f"{d}/out").outputMode("append") \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{d}/out")


def stock_alerts(ledger_rows: DataFrame) -> DataFrame:
    """Only the rows where stock crossed its minimum or reached 0."""
    return ledger_rows.where(F.col("alert").isNotNull()).select("id", "material_id", "balance", "alert")


# ----------------------------------------------------------------------------- J4
FEED_COLS = ["type", "ref", "detail", "amount", "status", "created_at", "source_rank", "id"]
FEED_LIMITS = {0: 5, 1: 4, 2: 4}


def _feed_shape(spark: SparkSession, sf_dir: str, tables, max_files: int | None = None) -> DataFrame:
    """The three feed sources as one stream in the feed's 6(+2)-column shape
    (stream-static joins for the names)."""
    so = stream_binding(spark, sf_dir, "sales_orders", max_files).join(
        tables.customers.select(F.col("id").alias("customer_id"), F.col("name").alias("_n")), "customer_id") \
        .select(F.lit("sale").alias("type"), F.col("order_number").alias("ref"), F.col("_n").alias("detail"),
                F.col("total_amount").cast("double").alias("amount"), "status", "created_at",
                F.lit(0).alias("source_rank"), "id")
    ml = stream_binding(spark, sf_dir, "material_logs", max_files).join(
        tables.raw_materials.select(F.col("id").alias("material_id"), F.col("name").alias("_n")), "material_id") \
        .select(F.lit("material").alias("type"), F.col("_n").alias("ref"), label("material_move", "type").alias("detail"),
                F.col("quantity").cast("double").alias("amount"), F.lit(None).cast("string").alias("status"),
                "created_at", F.lit(1).alias("source_rank"), "id")
    po = stream_binding(spark, sf_dir, "production_orders", max_files).join(
        tables.products.select(F.col("id").alias("product_id"), F.col("name").alias("_n")), "product_id") \
        .select(F.lit("production").alias("type"), F.col("_n").alias("ref"), F.col("status").alias("detail"),
                F.col("quantity_planned").cast("double").alias("amount"), "status", "created_at",
                F.lit(2).alias("source_rank"), "id")
    return so.unionByName(ml).unionByName(po)


def _top_per_source(df: DataFrame) -> DataFrame:
    parts = [df.where(F.col("source_rank") == r).orderBy(F.desc("created_at"), F.desc("id")).limit(k)
             for r, k in FEED_LIMITS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_activity_feed(spark: SparkSession, sf_dir: str, tables, k: int = 12, max_files: int | None = None,
                      job: str | None = None) -> DataFrame:
    """Keep the per-source newest rows in a small snapshot; each micro-batch
    is merged into it (top-k of old top-k + batch), and the feed is the first
    ``k`` of it. The snapshot never exceeds 13 rows."""
    d = run_dir(spark, "j4", job)

    def merge(prev: DataFrame | None, batch: DataFrame, n: int) -> DataFrame:
        new = batch.select(*FEED_COLS)
        return _top_per_source(new if prev is None else prev.select(*FEED_COLS).unionByName(new))

    _run(_feed_shape(spark, sf_dir, tables, max_files), d, snapshot_sink(spark, f"{d}/top", merge))
    return read_snapshot(spark, f"{d}/top").orderBy(F.desc("created_at"), "source_rank", F.desc("id")).limit(k)


# ----------------------------------------------------------------------------- J5
def dedupe_status_events(events: DataFrame, keys: tuple[str, ...] = ("order_id", "kind", "status"),
                         delay: str = "1 hour") -> DataFrame:
    """Drop repeated (entity, id, status) events that arrive within the
    watermark delay of each other (the reference applies a repeated
    received/completed/approved twice). Within one micro-batch every repetition
    goes, however far apart: the watermark moves between batches only."""
    x = events.withColumn("_et", F.col("ts").cast("timestamp")).withWatermark("_et", delay)
    return x.dropDuplicatesWithinWatermark(list(keys))


def run_dedupe(spark: SparkSession, sf_dir: str, delay: str = "1 hour", max_files: int | None = None,
               job: str | None = None) -> DataFrame:
    """Run J5 over the order-event stream and read back the kept events."""
    d = run_dir(spark, "j5", job)
    ev = stream_binding(spark, sf_dir, "order_events", max_files)
    q = (dedupe_status_events(ev, delay=delay).drop("_et").writeStream.outputMode("append").format("parquet")
         .option("path", f"{d}/out").option("checkpointLocation", f"{d}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{d}/out")
