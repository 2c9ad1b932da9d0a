"""Sharding by extendible hashing.

A document's hash bits (md5 of its id) lead through a directory to its shard. A shard is a hash
prefix; only a shard over the byte limit is split on one more bit, until every shard fits.
The directory is found from byte totals by prefix: totals of fine cells are added up to the totals
of all their prefixes, and a document's shard is its shortest prefix that fits. Cells that are too
large even at the finest prefix go on alone with more bits.

Defined results: NULL text has 0 bytes; a NULL id hashes as the empty text; rows with equal ids
cannot be told apart by hash bits, so where they alone exceed the limit their shard is split into
overflow pages by the same search over 60 bits of the text's hash, with the page's number in
``page`` (its bits behind a 1, so 0 is a shard without pages), until each fits or holds one text; a
single document over the limit (or equal rows of one id and text) keeps a page of its own with ``fits`` false; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, read_table, register

#: bytes of text in a shard; the registered query uses it for every table size
BYTE_LIMIT = 1 << 20
#: bits beyond log2(total / limit) that a round looks at
EXTRA_BITS = 6
MAX_BITS = 120
TEXT_BITS = 60


def hash_bits(doc_id: Column) -> Column:
    """120 hash bits as a text of 0 and 1."""
    h = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    parts = [F.lpad(F.conv(F.substring(h, 1 + 6 * i, 6), 16, 2), 24, "0") for i in range(5)]
    return F.concat(*parts)


def _prefix(bits: Column, depth: Column) -> Column:
    return F.substring(bits, F.lit(1), depth)


def _cells(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))


def _directory(rows: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """(cell of ``high`` bits, depth, bytes, docs, fits) where depth in low..high is the shortest
    prefix that fits, or ``high`` with fits false."""
    cells = _cells(rows, high)
    up = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    up = up.groupBy("depth", _prefix(F.col("cell"), F.col("depth")).alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    up = materialize(up.where((F.col("bytes") <= limit) | (F.col("depth") == high)), "prefixes")
    # no cell looks at depths where nothing fits: their few prefixes would be hot join keys
    least = up.agg(F.min("depth")).first()[0]
    pick = (cells.select("cell", F.explode(F.sequence(F.lit(low if least is None else least), F.lit(high))).alias("depth"))
            .withColumn("prefix", _prefix(F.col("cell"), F.col("depth"))).join(up, ["depth", "prefix"])
            .groupBy("cell").agg(F.min(F.struct("depth", "bytes", "docs")).alias("m")))
    return pick.select("cell", "m.depth", "m.bytes", "m.docs", (F.col("m.bytes") <= limit).alias("fits"))


def shards(docs: DataFrame, byte_limit: int = BYTE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, bytes, shard (its hash prefix; the empty text is the whole table),
    depth (its bits), page, shard_bytes, shard_docs, fits."""
    # the top bits are as even as the low ones; lpad keeps leading zeros
    text_bits = F.substring(F.lpad(F.bin(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), 64, "0"), 1, TEXT_BITS)
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), F.concat(hash_bits(F.col(id_col)), text_bits).alias("bits"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")), "shard-rows")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]  # one number
    done, low, last = [], 0, MAX_BITS + TEXT_BITS
    high = min(MAX_BITS, max(0, math.ceil(math.log2(max(total, 1) / byte_limit))) + EXTRA_BITS)
    while True:
        d = materialize(_directory(rows, byte_limit, low, high), "directory")
        placed = rows.join(d, F.substring("bits", 1, high) == F.col("cell"))
        keep = F.col("fits") | (F.col("docs") == 1) | F.lit(high >= last)
        done.append(placed.where(keep).select(
            "id", "bits", rows["bytes"].alias("bytes"), F.expr("substring(bits, 1, depth)").alias("prefix"), "depth",
            d["bytes"].alias("shard_bytes"), d["docs"].alias("shard_docs"), "fits"))
        if high >= last or d.where("NOT fits AND docs > 1").isEmpty():
            break
        rows = materialize(placed.where(~keep).select("id", "bits", rows["bytes"].alias("bytes")), "shard-rows")
        # the id's bits are looked at to their end before the text's
        low, high = high + 1, min(last if high >= MAX_BITS else MAX_BITS, high + 2 * EXTRA_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # a prefix that goes on into the text's bits is a page of its id's shard
    page = F.when(F.col("depth") > MAX_BITS, F.conv(F.concat(F.lit("1"), F.expr(f"substring(prefix, {MAX_BITS + 1})")), 2, 10).cast("long"))
    return out.select("id", "bytes", F.substring("prefix", 1, MAX_BITS).alias("shard"), F.least("depth", F.lit(MAX_BITS)).alias("depth"),
                      F.coalesce(page, F.lit(0).cast("long")).alias("page"), "shard_bytes", "shard_docs", "fits")


def directory(placed: DataFrame) -> DataFrame:
    """The directory of ``shards()``: one row per shard with the range of hash prefixes it owns, read
    as numbers of as many bits as the deepest shard has."""
    depth = placed.agg(F.max("depth").alias("d"))
    one = placed.select("shard", "depth", "page", "shard_bytes", "shard_docs", "fits").distinct()
    return one.withColumn("global_depth", depth.scalar()).select(
        "shard", "depth", "page", "shard_bytes", "shard_docs", "fits", "global_depth",
        F.expr("rpad(shard, global_depth, '0')").alias("first_entry"), F.expr("rpad(shard, global_depth, '1')").alias("last_entry"))


_DEPTHS = 30
ORACLE = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes,
         substr(bin(CAST('0x1' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)), 2) AS bits
  FROM documents),
p AS (SELECT k.depth, left(bits, k.depth) AS shard, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
      FROM d, (SELECT CAST(unnest(range({_DEPTHS})) AS INTEGER) AS depth) k GROUP BY ALL HAVING sum(bytes) <= {BYTE_LIMIT}),
m AS (SELECT doc_id, min(p.depth) AS depth FROM d JOIN p ON p.shard = left(d.bits, p.depth) GROUP BY doc_id)
SELECT d.doc_id, d.bytes, p.shard, m.depth, CAST(0 AS BIGINT) AS page, p.shard_bytes, p.shard_docs, TRUE AS fits
FROM d JOIN m USING (doc_id) JOIN p ON p.depth = m.depth AND p.shard = left(d.bits, m.depth)
"""


@register("op9_extendible_shards", ORACLE)
def op9_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, with shards of at most 1 MiB of text."""
    return shards(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
