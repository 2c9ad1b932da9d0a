"""Two-level running totals that keep a hot key spread over many tasks.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of one key in one
task; with a key that holds a third of all rows that task is the job. Here the
ordered rows are cut into blocks of about equal row counts - at places (the first
two order columns) that a sample of the rows gives, as many as the cluster has
shuffle partitions, times ``BLOCKS_PER_PARTITION`` - so that:

1. a window over ``(key, block)`` gives the running total inside each block;
2. a group-by over ``(key, block)`` gives one total per block (a frame that is
   at most keys x blocks long, with map-side partial aggregation);
3. a window over that small frame gives each block's offset = the sum of all
   earlier blocks of the key;
4. a join on ``(key, block)`` adds the offset back.

Only step 3 partitions by the bare key, and it sees one row per block. Rows of one
time (a bulk load) fall into different blocks by the second order column. Keys are compared as texts with a
mark for NULL, filled in once before the first exchange, so the join of step 4
is a plain equality join on the window's own partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLK, KEY = "_blk", "_key"
MONEY = "decimal(18,4)"
BLOCKS_PER_PARTITION = 4
_SAMPLE = 16


def _number(df: DataFrame, col: str) -> Column:
    """The order column as a whole number that sorts alike."""
    kind, c = df.schema[col].dataType, F.col(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_date(c) if isinstance(kind, T.DateType) else c.cast("long")


def _place(df: DataFrame, order: Sequence[str]) -> Column:
    """The first two order columns as whole numbers that sort alike: rows of one time differ by the second."""
    return F.struct(_number(df, order[0]).alias("a"), (_number(df, order[1]) if len(order) > 1 else F.lit(0).cast("long")).alias("b"))


def block_cuts(df: DataFrame, *order: str, blocks: int | None = None) -> Column:
    """Where blocks of ``df`` begin, as a scalar subquery: places that cut a sample of its rows (the first
    ``_SAMPLE`` by hash for each block) into equal parts. Scans over frames that are derived from ``df``
    and have the same first order columns share it."""
    n = blocks or BLOCKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    some = df.select(_place(df, order).alias("p")).orderBy(F.xxhash64("p"), "p").limit(n * _SAMPLE)
    some = some.agg(F.array_sort(F.collect_list("p")).alias("p")).withColumn("n", F.size("p"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("p", F.floor(i * F.col("n") / n).cast("int")))
    at = F.when((F.col("n") > 0) & F.lit(n > 1), F.array_distinct(F.filter(at, lambda p: p.isNotNull())))
    some = some.select(F.coalesce(at, F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("fine"))
    some = some.withColumn("step", F.greatest(F.floor(F.sqrt(F.size("fine"))), F.lit(1)).cast("int"))
    coarse = F.transform(F.sequence(F.lit(0), F.floor((F.size("fine") - 1) / F.col("step")).cast("int")), lambda i: F.get("fine", i * F.col("step")))
    coarse = F.when(F.size("fine") > 0, coarse).otherwise(F.col("fine"))
    return some.select(F.struct("fine", "step", coarse.alias("coarse")).alias("cuts")).scalar()


def _blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: Column | None) -> DataFrame:
    """``df`` with the block number and the keys as one text column without NULLs."""
    v = _place(df, order)
    df = df.withColumn("_cuts", cuts if cuts is not None else block_cuts(df, *order[:2]))
    # every some cuts first, then among these: few comparisons however many blocks there are
    c = F.col("_cuts")
    coarse = F.greatest(F.size(F.filter(c["coarse"], lambda p: p <= v)) - 1, F.lit(0)) * c["step"]
    fine = F.element_at(F.transform(F.array(coarse), lambda k: k + F.size(F.filter(F.slice(c["fine"], k + 1, c["step"]), lambda p: p <= v))), 1)
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys]
    return df.withColumn(BLK, F.coalesce(fine, F.lit(0))).withColumn(
        KEY, F.concat_ws("\0", *parts) if parts else F.lit("")).drop("_cuts")


def _local(order: Sequence[Column | str]):
    return Window.partitionBy(KEY, BLK).orderBy(*order)


def _blocks():
    return Window.partitionBy(KEY).orderBy(BLK)


def _earlier():
    return _blocks().rowsBetween(Window.unboundedPreceding, -1)


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                inclusive: bool = True, cuts: Column | None = None) -> DataFrame:
    """Add one running-sum column per entry of ``values`` (per key, in ``order``).

    ``inclusive=False`` gives the sum over strictly earlier rows.
    """
    d = _blocked(df, keys, order, cuts).withColumns({f"_v_{n}": c for n, c in values.items()})
    w = _local(order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = d.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)).alias(f"_l_{n}") for n in values])
    totals = d.groupBy(KEY, BLK).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    offsets = totals.select(KEY, BLK, *[F.coalesce(F.sum(f"_t_{n}").over(_earlier()), F.lit(0)).alias(f"_o_{n}") for n in values])
    out = local.join(offsets, [KEY, BLK]).withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in values})
    return out.select(*df.columns, *[n for n in values if n not in df.columns])


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, where: Column | None = None,
                  inclusive: bool = True, cuts: Column | None = None) -> DataFrame:
    """Row number per key (``where`` given: count of earlier qualifying rows)."""
    one = F.lit(1).cast("long") if where is None else F.when(where, 1).otherwise(0).cast("long")
    return prefix_sums(df, keys, order, {name: one}, inclusive=inclusive, cuts=cuts)


def clamped_balance(df: DataFrame, keys: Sequence[str], order: Sequence[str], delta: Column, clamp: Column,
                    initial: Column, name: str = "balance", cuts: Column | None = None) -> DataFrame:
    """Running balance where ``clamp`` rows floor the balance at 0.

    Sequentially: ``bal = bal + d`` on plain rows, ``bal = max(0, bal + d)`` on
    clamped rows, starting from ``initial``. Closed form (a Lindley recursion):
    with ``S`` the running sum of ``d`` and ``M`` the running max of ``-S`` over
    clamped rows, ``bal = S + max(initial, M)``. Both running sum and running
    max are associative, so the same two-level block scheme as ``prefix_sums``
    applies. A block's largest ``-S`` needs its rows in order, so block totals
    come from the window's result: of each block its last row.
    """
    # exact decimals: the block split re-associates the sums, doubles would
    # then differ in their last bits from a one-pass running sum
    d = _blocked(df, keys, order, cuts).withColumn("_d", delta.cast(MONEY)).withColumn("_c", clamp) \
        .withColumn("_x0", initial.cast(MONEY))
    w = _local(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_s", F.sum("_d").over(w))
    d = d.withColumn("_m", F.max(F.when(F.col("_c"), -F.col("_s"))).over(w))
    blocks = d.groupBy(KEY, BLK).agg(F.sum("_d").alias("_bd"), F.max(F.when(F.col("_c"), -F.col("_s"))).alias("_bm"))
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_bd").over(_earlier()), F.lit(0).cast(MONEY)))
    blocks = blocks.withColumn("_pm", F.max(F.col("_bm") - F.col("_off")).over(_earlier())).drop("_bd", "_bm")
    s = F.col("_off") + F.col("_s")
    m = F.greatest(F.col("_pm"), F.col("_m") - F.col("_off"))  # greatest() skips NULLs
    out = d.join(blocks, [KEY, BLK]).withColumn(name, (s + F.greatest(F.col("_x0"), m)).cast("double"))
    return out.select(*df.columns, *([] if name in df.columns else [name]))


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str,
                   cuts: Column | None = None) -> DataFrame:
    """``lag(value)`` per key without one task per key: lag inside each block, and
    for a block's first row the last value of the key's previous block (taken
    from the small per-block frame). Adds ``name`` and ``_is_first`` (first row
    of the key, where the lag is undefined)."""
    d = _blocked(df, keys, order, cuts)
    w = _local(order)
    d = d.withColumn(name, F.lag(value).over(w)).withColumn("_rn", F.row_number().over(w))
    last = d.groupBy(KEY, BLK).agg(F.max_by(F.col(value), F.struct(*order)).alias("_lastv"))
    last = last.select(KEY, BLK, F.lag("_lastv").over(_blocks()).alias("_pv"), (F.row_number().over(_blocks()) == 1).alias("_first_blk"))
    first_in_blk = F.col("_rn") == 1
    out = d.join(last, [KEY, BLK]).withColumn(name, F.when(first_in_blk, F.col("_pv")).otherwise(F.col(name)))
    return out.withColumn("_is_first", first_in_blk & F.col("_first_blk")).select(
        *df.columns, *([] if name in df.columns else [name]), "_is_first")


def fill_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str,
                cuts: Column | None = None) -> DataFrame:
    """The last non-NULL ``value`` strictly before each row, per key in order
    (a forward fill), with the same two-level block scheme: a window inside
    each (key, block), the last value of every block from a group-by, and the
    carry from earlier blocks over the small per-block frame."""
    d = _blocked(df, keys, order, cuts).withColumn("_fv", value)
    w = _local(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_fl", F.last("_fv", ignorenulls=True).over(w))
    blocks = d.groupBy(KEY, BLK).agg(
        F.max_by(F.col("_fv"), F.when(F.col("_fv").isNotNull(), F.struct(*order))).alias("_bl"))
    blocks = blocks.select(KEY, BLK, F.last("_bl", ignorenulls=True).over(_earlier()).alias("_carry"))
    out = d.join(blocks, [KEY, BLK]).withColumn(name, F.coalesce(F.col("_fl"), F.col("_carry")))
    return out.select(*df.columns, *([] if name in df.columns else [name]))


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]],
            cuts: Column | None = None) -> DataFrame:
    """Several segmented scans as one: for each entry ``name: (which, value)`` the ``first`` or ``last``
    non-NULL value strictly before each row, per key in order. "First" and "last" of all entries
    together are one associative state: one exchange of the rows, one window inside the blocks, one
    frame of a row per block that carries every entry on."""
    d = _blocked(df, keys, order, cuts).withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    pick = {"first": F.first, "last": F.last}
    w = _local(order).rowsBetween(Window.unboundedPreceding, -1)
    place = {n: F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order)) for n in values}
    of_block = {"first": F.min_by, "last": F.max_by}
    blocks = d.groupBy(KEY, BLK).agg(*[of_block[which](F.col(f"_v_{n}"), place[n]).alias(f"_b_{n}") for n, (which, _) in values.items()])
    blocks = blocks.select(KEY, BLK, *[pick[which](f"_b_{n}", ignorenulls=True).over(_earlier()).alias(f"_c_{n}")
                                       for n, (which, _) in values.items()])
    local = d.select("*", *[pick[which](f"_v_{n}", ignorenulls=True).over(w).alias(f"_l_{n}") for n, (which, _) in values.items()])
    out = local.join(blocks, [KEY, BLK])
    both = {n: (F.col(f"_c_{n}"), F.col(f"_l_{n}")) if which == "first" else (F.col(f"_l_{n}"), F.col(f"_c_{n}"))
            for n, (which, _) in values.items()}
    return out.select(*df.columns, *[F.coalesce(*both[n]).alias(n) for n in values])
