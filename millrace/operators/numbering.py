"""2G: document numbering and sequences, re-aimed from insert-time rules.

All running numbers use the two-level running count (``plans.scan``), so
neither a global numbering nor one busy day ever lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.scan import running_count


def assign_document_numbers(new: DataFrame, prefix: str, start: int | Column = 0,
                            order: tuple[str, ...] = ("created_at", "id"), name: str = "doc_number") -> DataFrame:
    """G1: ``prefix`` + (start + n) padded to at least 5 digits, n = 1.. in ``order``.

    ``start`` is the current maximum id: an int, or a Column such as
    ``existing.agg(F.max("id")).scalar()`` (a scalar subquery, no join)."""
    x = running_count(new, [], list(order), "_n")
    s = start if isinstance(start, Column) else F.lit(start)
    return x.withColumn("seq_no", (F.coalesce(s, F.lit(0)) + F.col("_n")).cast("long")) \
        .withColumn(name, F.format_string(prefix + "%05d", F.col("seq_no"))).drop("_n")


def assign_batch_numbers(po: DataFrame, strict: bool = False) -> DataFrame:
    """``B<yyyyMMdd>-<nnn>`` with nnn = 1 + earlier non-cancelled orders of the
    same UTC day (at least 3 digits); expiry = day + 365. Like the reference, a
    number can repeat after a cancellation (see L5); ``strict=True`` counts
    cancelled orders too, so numbers never repeat."""
    x = po.withColumn("_day", F.to_date("created_at"))
    x = running_count(x, ["_day"], ["created_at", "id"], "_k",
                      where=None if strict else F.col("status") != "cancelled", inclusive=False)
    return (x.withColumn("batch_number", F.format_string("B%s-%03d", F.date_format("_day", "yyyyMMdd"),
                                                         (F.col("_k") + 1).cast("int")))
            .withColumn("expiry_date", F.date_add("_day", 365)).drop("_day", "_k"))


def route_sequence(routes: DataFrame, ids_col: str = "order_ids", key: str = "route_id") -> DataFrame:
    """An array of order ids per route -> one row per order with its 1-based
    sequence number and the route's total_orders."""
    return routes.select(key, F.size(ids_col).alias("total_orders"),
                         F.posexplode(ids_col).alias("_pos", "order_id")) \
        .select(key, "order_id", (F.col("_pos") + 1).alias("sequence_number"), "total_orders")
