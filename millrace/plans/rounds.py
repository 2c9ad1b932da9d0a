"""Rules whose decisions depend on earlier accepted rows, decided in few rounds of prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.scan import fill_before, prefix_sums
from millrace.session import ensure_checkpoint_dir

#: keys of at most this many rows are walked, each as one array
SHORT = 1024


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends there."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/rounds/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def capacity_rounds(rows: DataFrame, key: str, order: Sequence[str], amount: str, room: str, short: int = SHORT) -> DataFrame:
    """``rows`` with two more columns, ``accepted`` and ``used``: per key in ``order`` a row is accepted
    if its amount fits into what is left of the key's ``room`` (one value per key), and
    only accepted rows use it up; ``used`` is what is used after the row. Amounts and room are long.

    What is left never grows, so an amount above it is refused for good. Let ``left`` be what is left
    when a round begins. Amounts of up to half of it are all accepted, in order, until either their sum
    passes that half or one of the larger amounts fits; that row is accepted too and ends the round,
    as what is left has halved. So a round is one running sum and one minimum per key, a key takes at
    most log2(room / least amount) rounds, and a hot key's rows stay spread over all tasks. (A negative
    amount is accepted, gives room back and ends a round as well.)

    Only keys of more than ``short`` rows take such rounds; shorter ones are walked row by row, all in one
    pass over the table. Rows that repeat are decided one by one."""
    spare = [c for c in ("_left", "_sum", "_before", "_end", "_at", "_next", "_long", "_neg", "_open", "_some", "_row", "_no") if c in rows.columns]
    if spare:
        raise ValueError(f"columns {spare} are taken")
    order = [*order, "_no"]
    rows = written(rows.withColumn("_no", F.monotonically_increasing_id()), "rows")
    long = written(rows.groupBy(F.col(key).alias("_long")).count().where(F.col("count") > short).select("_long"), "long")
    if long.isEmpty():
        return _walked(rows, key, order, amount, room).drop("_no")
    same = F.col(key).eqNullSafe(F.col("_long"))
    return _walked(rows.join(long, same, "left_anti"), key, order, amount, room).unionByName(
        _rounds(rows.join(long, same, "left_semi"), key, order, amount, room)).drop("_no")


def _walked(rows: DataFrame, key: str, order: Sequence[str], amount: str, room: str) -> DataFrame:
    """Keys of few rows: the plain loop through each key's rows, as one sorted array."""
    x = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("_row")))).alias("_some"))
    zero = F.lit(0).cast("long")

    def step(s: Column, r: Column) -> Column:
        a = r["_row"][amount]
        fits = F.coalesce(a <= r["_row"][room] - s["used"], F.lit(False))
        used = s["used"] + F.when(fits, a).otherwise(zero)
        return F.struct(used.alias("used"), F.array_append(s["done"], F.struct(fits.alias("accepted"), used.alias("used"))).alias("done"))

    begin = F.struct(zero.alias("used"), F.array().cast("array<struct<accepted:boolean,used:bigint>>").alias("done"))
    done = F.aggregate("_some", begin, step, lambda s: s["done"])
    x = x.select(F.explode(F.arrays_zip(F.col("_some._row").alias("_row"), done.alias("done"))).alias("_some"))
    return x.select(*[F.col("_some._row")[c].alias(c) for c in rows.columns], "_some.done.accepted", "_some.done.used")


def _rounds(rows: DataFrame, key: str, order: Sequence[str], amount: str, room: str) -> DataFrame:
    """The rounds of hot keys. A row that is refused for good leaves as soon as that is known, if its key has no
    negative amount, so rounds get shorter; what is used after it is filled in at the end."""
    cols, at = rows.columns, F.struct(*order)
    neg = rows.where(F.col(amount) < 0).select(F.col(key).alias("_neg")).distinct()
    todo = rows.join(neg, F.col(key).eqNullSafe(F.col("_neg")), "left")
    todo, done = todo.withColumn("_open", F.col("_neg").isNotNull()).drop("_neg").withColumn("_left", F.col(room)), []
    a, left = F.col(amount), F.col("_left")
    small = (a >= 0) & (2 * a <= left)
    while True:
        x = prefix_sums(todo, [key], order, {"_sum": F.when(small, a).otherwise(F.lit(0).cast("long"))})
        x = x.withColumn("_before", F.col("_sum") - F.when(small, a).otherwise(0))
        ends = F.when(small, 2 * F.col("_sum") > left).otherwise(a <= left - F.col("_before"))
        x = written(x.withColumn("_end", ends & (a != 0)), "round")
        stop = x.where("_end").groupBy(F.col(key).alias("_key")).agg(F.min(at).alias("_at"), F.min_by(left - F.col("_before") - a, at).alias("_next"))
        stop = written(stop, "ends")
        x = x.join(stop, F.col(key).eqNullSafe(F.col("_key")), "left")
        later = F.coalesce(at > F.col("_at"), F.lit(False))
        last = F.coalesce(at == F.col("_at"), F.lit(False))
        gone = later & ~F.col("_open") & (a > F.col("_next"))
        done.append(x.where(~later | gone).select(*cols, (~later & (small | last)).alias("accepted"), F.when(~later, F.col(room) - left + F.when(
            last, F.col("_before") + a).otherwise(F.col("_sum"))).alias("used")))
        if stop.isEmpty():
            break
        todo = x.where(later & ~gone).select(*cols, "_open", F.col("_next").alias("_left"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = fill_before(out, [key], order, F.col("used"), "_before")
    return out.select(*cols, "accepted", F.coalesce("used", "_before", F.lit(0).cast("long")).alias("used"))
