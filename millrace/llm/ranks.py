"""Places of rows in their groups, without a group ever being one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import fresh, materialize, shuffle_parts


def ranked(rows: DataFrame, group: str, order: list[Column], rank: str = "rank", size: str = "size") -> DataFrame:
    """``rows`` with two more columns: their place in the group by ``order``, from 0, and the number
    of rows of the group. ``group`` must not be NULL. Rows are dealt and sorted by ranges of (group,
    order); a group's offsets come from a frame of one row per range and group. Equal rows keep
    places of their own, dealt like any others, by a number that only splits ties."""
    turn, part, place = (fresh(rows, x) for x in ("turn", "part", "place"))
    first, before = fresh(rows, "first"), fresh(rows, "before")
    dealt = rows.withColumn(turn, F.monotonically_increasing_id())
    by = [F.col(group).asc(), *order, F.col(turn).asc()]
    dealt = dealt.repartitionByRange(shuffle_parts(rows.sparkSession), *by).sortWithinPartitions(*by).drop(turn)
    dealt = materialize(dealt.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "ranked")
    counts = dealt.groupBy(group, part).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(size))
    parts = Window.partitionBy(group)
    earlier = parts.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, part, first, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before),
                           F.sum(size).over(parts).alias(size))
    out = dealt.join(counts, [group, part]).withColumn(rank, F.col(before) + F.col(place) - F.col(first))
    return out.select(*rows.columns, rank, size)
