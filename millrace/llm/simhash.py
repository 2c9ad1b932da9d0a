"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact Hamming check, components.

Fingerprint: words are split at ASCII white space after lower-casing A-Z; each run of three words,
joined by single spaces (a text of fewer words: all of them), is hashed with XXH64 (seed 42);
a bit is 1 if more than half of the hashes have it. No words: fingerprint 0, linked like any other.

Linking works on distinct fingerprints, so copies cost nothing. 64 bits are cut into six blocks;
fingerprints at most three bits apart agree on at least three of them, so they meet in one of the
20 triples of blocks. A triple's bucket of up to ``PAIRWISE`` fingerprints is compared pair by pair
and gives a spanning forest, so its links are fewer than its fingerprints. Larger buckets are never
compared: rounds give each component of theirs one link to a smaller one within three bits, found at
common neighbours (two fingerprints are within three bits exactly if some 64-bit value is within one
bit of one and two bits of the other). A round at least halves the components that can still be
linked, and buckets that have become one component drop out, so links and rows grow with the
fingerprints, not with the square of a group.

Components: minimum labels with pointer jumping, each round written to the shared folder.

Defined results: repeated rows share a component; a NULL id takes part and gets the smallest id
reachable, NULL if there is none; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, fresh, materialize, read_table, register, texts

SHINGLE = 3
MAX_BITS_APART = 3
SEED = 42
#: largest bucket that is compared pair by pair
PAIRWISE = 64
_WIDTHS = (11, 11, 11, 11, 10, 10)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        a, b = starts[i:min(n, i + (1 << 16))].tolist(), ends[i + shingle - 1:min(n, i + (1 << 16)) + shingle - 1].tolist()
        h = np.fromiter((digest(line[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer."""
    @F.arrow_udf("long")
    def simhash(col: pa.Array) -> pa.Array:
        return pa.array([_signed(text_fingerprint(x, shingle)) for x in texts(col)], pa.int64())
    return simhash(text)


def _masks() -> list[int]:
    at, blocks = 0, []
    for w in _WIDTHS:
        blocks.append(((1 << w) - 1) << at)
        at += w
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _ball(radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{_signed(x)}L" if _signed(x) != -(1 << 63) else "shiftleft(1L, 63)" for x in values) + ")")


def forest(xs: Column) -> Column:
    """The fingerprints of a bucket -> (a, b) for each that is close, directly or by others of the
    bucket, to a smaller one; b is the smallest of these."""
    def grow(made: Column, x: Column) -> Column:
        near = F.transform(F.filter(made, lambda e: F.bit_count(e.a.bitwiseXOR(x)) <= MAX_BITS_APART), lambda e: e.b)
        # a one-element array binds ``near``, which would be computed for each use otherwise
        return F.transform(F.array(near), lambda roots: F.when(F.size(roots) == 0, F.concat(made, F.array(node(x, x)))).otherwise(
            F.concat(F.transform(made, lambda e: node(e.a, F.when(F.array_contains(roots, e.b), F.array_min(roots)).otherwise(e.b))),
                     F.array(node(x, F.array_min(roots))))))[0]

    def node(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))
    grown = F.aggregate(F.array_sort(xs), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), grow)
    return F.filter(grown, lambda e: e.a != e.b)


def links(fps: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """``fps(fp)``, distinct -> (a, b): links enough to connect all fingerprints that are at most
    three bits apart, directly or by others. A bucket of up to ``pairwise`` gives a link less than it
    has fingerprints; those of larger buckets get a link per component and round, and rounds go on
    until every large bucket is one component or none of its components are close."""
    keys = _longs(_masks())
    rows = fps.select("fp", F.posexplode(F.transform(keys, lambda m: m.bitwiseAND(F.col("fp")))).alias("triple", "key"))
    counts = materialize(rows.groupBy("triple", "key").count().where("count > 1"), "buckets")
    shared = materialize(rows.join(counts, ["triple", "key"]), "shared")
    small = shared.where(F.col("count") <= pairwise).groupBy("triple", "key").agg(forest(F.collect_list("fp")).alias("near"))
    known = [materialize(small.select(F.explode("near").alias("e")).select("e.a", "e.b").distinct(), "links")]
    large = materialize(shared.where(F.col("count") > pairwise).select("fp", "triple", "key"), "large")
    discard(counts, shared)
    while True:
        edges = reduce(DataFrame.unionByName, known)
        if large.isEmpty():
            return edges
        labels = components(edges).withColumnRenamed("node", "fp")
        named = large.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        mixed = named.groupBy("triple", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        named = materialize(named.join(mixed.select("triple", "key"), ["triple", "key"], "left_semi"), "large")
        crowd = materialize(named.select("fp", "label").distinct(), "crowd")
        hooks = materialize(_hooks(crowd), "links")
        discard(large, crowd)
        if hooks.isEmpty():
            return edges
        known.append(hooks)
        large = named.drop("label")


def _hooks(crowd: DataFrame) -> DataFrame:
    """``crowd(fp, label)`` -> (a, b): for each label that has smaller ones within three bits of a
    fingerprint of its, one of these. Two fingerprints are within three bits exactly if some value is
    within one bit of one and two bits of the other: every value's least label within one bit is
    looked up from within two bits."""
    spread = lambda r: crowd.select("label", F.explode(_longs(_ball(r))).alias("m"), "fp").select(
        "label", F.col("fp").bitwiseXOR(F.col("m")).alias("z"))
    heads = spread(1).groupBy("z").agg(F.min("label").alias("head"))
    # rows per fingerprint are many more than Spark's size estimate knows, so never a broadcast
    met = spread(2).join(heads.hint("merge"), "z").where("head < label")
    return met.groupBy(F.col("label").alias("a")).agg(F.min("head").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> (node, label): the smallest node reachable, for every node with an edge."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                         .withColumnRenamed("a", "node"), "labels")
    before = labels
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        step = step.join(jump, "low").select("node", F.least("low", "lower").alias("label"), F.col("label").alias("was"))
        step = materialize(step, "labels")
        discard(before)
        if step.where("label < was").isEmpty():
            discard(both)
            return step.select("node", "label")
        before, labels = step, step.select("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, pairwise: int = PAIRWISE) -> DataFrame:
    """A row per document: id, fp (signed), component_id (smallest id reachable, its own included),
    component_fp (smallest fingerprint of the component)."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    labels = components(links(fps.select("fp"), pairwise))
    named = fps.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("component_fp"))
    least = named.groupBy("component_fp").agg(F.min("first").alias("component_id"))
    named = named.select("fp", "component_fp").join(least, "component_fp")
    return rows.join(materialize(named, "components"), "fp").select("id", "fp", "component_id", "component_fp")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that of the smallest id, of several texts with that id the one
    of the smallest fingerprint, and of repeated rows of it (or of a component without ids) one row."""
    near = materialize(near_duplicates(docs, id_col, text_col), "near")
    # the ids that go are fewer than those that stay; rows of an id that repeats are told apart by fingerprint
    key, fp, rep = fresh(docs, "other_id"), fresh(docs, "fp"), fresh(docs, "component_fp")
    ids = near.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("id") != F.col("component_id")).alias("goes"))
    away = materialize(ids.where("n > 1 OR goes").select(F.col("id").alias(key), "n"), "away")
    out = docs.where(F.col(id_col).isNotNull()).join(away.select(key), F.col(id_col) == F.col(key), "left_anti")
    twice = materialize(away.where("n > 1").select(key), "twice")
    if not twice.isEmpty():
        stay = near.where("id = component_id").join(twice, F.col("id") == F.col(key), "left_semi")
        stay = stay.groupBy(F.col("id").alias(key), F.col("component_fp").alias(rep)).agg(F.min("fp").alias(fp))
        stay = materialize(stay.select(key, fp), "stay")
        again = docs.join(twice, F.col(id_col) == F.col(key), "left_semi").withColumn(fp, fingerprint(F.col(text_col)))
        again = again.join(stay.withColumnRenamed(fp, rep), (F.col(id_col) == F.col(key)) & (F.col(fp) == F.col(rep)), "left_semi")
        out = out.unionByName(again.dropDuplicates([id_col, fp]).drop(fp))
    nameless = near.where("component_id IS NULL").select("fp", "component_fp").distinct()
    if not nameless.isEmpty():
        one = docs.where(F.col(id_col).isNull()).withColumn(fp, fingerprint(F.col(text_col))).join(
            nameless.select(F.col("fp").alias(fp), F.col("component_fp").alias(rep)), fp)
        out = out.unionByName(one.dropDuplicates([rep]).drop(fp, rep))
    return out


@register("op8_simhash_dedup")
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    near = near_duplicates(read_table(spark, sf_dir, "documents"))
    return near.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
