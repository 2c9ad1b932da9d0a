"""B11 and B12 over a stored trigram index.

Every three characters in a row of a folded text are a gram. The index holds, for each column, gram and
block of ``BLOCK`` ids, the sorted ids of the block whose text has the gram, so no list is longer than
a block however common the gram is. It is a stored table by block (``sources.stored``), sorted by gram:
a search reads the row groups of its grams, intersects the lists block by block, and checks the
candidates by the very comparison of the scan (``sqlite_like_contains`` or ``js_contains``) on the same folding, so
grams lose no hit and wildcards stay wildcards. A text without three literal characters in a row has no grams
and is searched by the scan. New and changed rows mean that their blocks are built again, and no others.

Ids are whole numbers, one row each; rows with a NULL id are not indexed and not found. NULL texts have no grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.filters import contains_filter, global_search
from millrace.sources.stored import StoredTable

BLOCK = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class TrigramIndex:
    """The grams of text columns ``cols``; ``fold`` is ``like`` (A-Z only, ``%`` and ``_`` are wildcards in a
    searched text) or ``lower`` (all letters, no wildcards)."""

    def __init__(self, spark: SparkSession, path: str, cols: Sequence[str], fold: str = "like", id: str = "id", buckets: int = 64):
        if fold not in ("like", "lower"):
            raise ValueError(f"no folding {fold}")
        self.cols, self.fold, self.id = list(cols), fold, id
        self.stored = StoredTable(spark, path, ["block"], buckets, ["gram"])

    def _block(self) -> Column:
        return F.floor(F.col(self.id) / F.lit(BLOCK)).cast("long")

    def _folded(self, c: Column) -> Column:
        return F.translate(c, _UPPER, _LOWER) if self.fold == "like" else F.lower(c)

    def postings(self, rows: DataFrame) -> DataFrame:
        """(col, gram, block, ids) of ``rows``."""
        texts = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), self._folded(F.col(c).cast("string")).alias("t")) for c in self.cols]))
        x = rows.where(F.col(self.id).isNotNull()).select(F.col(self.id).cast("long").alias("i"), self._block().alias("block"), texts.alias("x"))
        x = x.where(F.char_length("x.t") >= 3)
        grams = F.transform(F.sequence(F.lit(1), F.char_length("x.t") - 2), lambda n: F.substring(F.col("x.t"), n, F.lit(3)))
        x = x.select("i", "block", "x.col", F.explode(F.array_distinct(grams)).alias("gram"))
        return x.groupBy("block", "col", "gram").agg(F.array_sort(F.collect_set("i")).alias("ids"))

    def build(self, batch: int, rows: DataFrame) -> bool:
        """Index the whole table."""
        return self.stored.load(batch, self.postings(rows))

    def rebuild(self, batch: int, changed: DataFrame, rows: DataFrame) -> bool:
        """Index the blocks of the ids ``changed`` again from ``rows``, the table after the change
        (of which these blocks' rows are read)."""
        blocks = changed.where(F.col(self.id).isNotNull()).select(self._block().alias("block")).distinct()
        here = rows.withColumn("_b", self._block()).join(blocks.withColumnRenamed("block", "_b"), "_b", "left_semi").drop("_b")
        return self.stored.merge(batch, blocks, lambda old: old.join(blocks, "block", "left_anti").unionByName(self.postings(here)))

    def grams(self, q: str) -> list[str]:
        """The grams that a text holding ``q`` must have."""
        q = q.translate(str.maketrans(_UPPER, _LOWER)) if self.fold == "like" else q.lower()
        runs = re.split("[%_]", q) if self.fold == "like" else [q]
        return sorted({r[i:i + 3] for r in runs for i in range(len(r) - 2)})

    def candidates(self, q: str, cols: Iterable[str] | None = None) -> DataFrame | None:
        """The ids (column ``id``) whose text in one of ``cols`` has all grams of ``q``; None if ``q`` has none."""
        grams = self.grams(q)
        if not grams:
            return None
        lists = self.stored.read().where(F.col("gram").isin(grams) & F.col("col").isin(list(cols or self.cols)))
        # one list per gram: as many as q has grams, each of a block's length at most
        both = lists.groupBy("block", "col").agg(F.collect_list("ids").alias("l")).where(F.size("l") == len(grams))
        kept = F.aggregate(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), F.element_at("l", 1), F.array_intersect)
        return both.select(F.explode(kept).alias("id")).distinct()

    def reduce(self, rows: DataFrame, q: str) -> DataFrame:
        """The rows of the indexed table that may hold ``q``."""
        found = self.candidates(q)
        return rows if found is None else rows.join(found.withColumnRenamed("id", "_cand"), F.col(self.id) == F.col("_cand"), "left_semi")


def indexed_contains(df: DataFrame, index: TrigramIndex, cols: Sequence[str], q: str, type_value: str | None = None) -> DataFrame:
    """B12 by an index of ``df`` (folding ``lower``) that covers ``cols``."""
    if index.fold != "lower" or not set(cols) <= set(index.cols):
        raise ValueError("the index does not serve this search")
    return contains_filter(index.reduce(df, q) if q else df, cols, q, type_value)


def indexed_search(customers: DataFrame, products: DataFrame, orders: DataFrame, of_customers: TrigramIndex,
                   of_products: TrigramIndex, of_orders: TrigramIndex, q: str, k: int = 5) -> DataFrame:
    """B11 by indexes (folding ``like``) of customers (name, code, phone), products (name, code) and orders
    (order_number); an order is also a candidate if its customer's name is."""
    for index, cols in ((of_customers, {"name", "code", "phone"}), (of_products, {"name", "code"}), (of_orders, {"order_number"})):
        if index.fold != "like" or not cols <= set(index.cols):
            raise ValueError("the indexes do not serve this search")
    q = (q or "").strip()
    if not of_customers.grams(q):
        return global_search(customers, products, orders, q, k)
    numbered = of_orders.candidates(q).select(F.col("id").alias("_o"))
    named = of_customers.candidates(q, ["name"]).select(F.col("id").alias("_c"))
    some = orders.join(numbered, F.col("id") == F.col("_o"), "left").join(named, F.col("customer_id") == F.col("_c"), "left")
    some = some.where(F.col("_o").isNotNull() | F.col("_c").isNotNull()).drop("_o", "_c")
    return global_search(of_customers.reduce(customers, q), of_products.reduce(products, q), some, q, k, buyers=customers)
