"""Merkle manifest of a dataset: nested-struct rollup of rank digits, proofs by transform and explode.

A leaf is the SHA-256 of a row's fields. Per group (source) the leaves ascend by id; runs of three
become one node until one node remains, the subroot; subroots, by group, become the root likewise.

A leaf's rank in its group, written in base 3, is its way through the tree. Ranks are cut into blocks
of 3^6 leaves. Within a block the digits are grouped away one after the other, lowest first: each
``groupBy`` of the remaining digits collects at most three child structs into their parent's, so after
six of them a block is one row that nests its whole subtree (729 leaves at most). Rows are dealt by
(group, block) once; all six groupings use that. Blocks are the leaves of the next tier. On the way
down one ``transform`` over the nested structs gives each leaf the siblings beside its way, and
``explode`` emits them: no leaf is ever joined with a node, only a block's row with the one row of the
tier above that is its own.

Defined results: NULL fields are hashed as ``-``, an empty text as ``0:``; a NULL group is a group of
its own and comes first, as do NULL ids within a group; rows with equal ids are ordered by their leaf's
hash, and equal rows are leaves of their own; very long texts are hashed whole; an empty table gives an
empty result; ids of any type that can be ordered; only the named columns are read, so other columns
may have any name. A hot group is as many blocks as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import crc32_sql, materialize, read_table, register
from millrace.llm.ranks import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: digits that are grouped away within a block
LEVELS = 6
BLOCK = ARITY ** LEVELS
_NO_STEPS = "cast(array() as array<struct<left:string,right:string>>)"


def digest(parts: Column) -> Column:
    """Lowercase hex SHA-256 of a string."""
    return F.sha2(parts.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it is hashed: its UTF-8 byte count, a colon and the value; ``-`` if NULL."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*(field(v) for v in values)))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n.h), "")


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows(g, rank, size, h, load)`` -> (g, rank, size, h, kids, leaves): a row per block, whose rank
    and size are those of the tier above, with its subtree nested in ``kids``."""
    digits = [F.expr(f"cast(rank div {ARITY ** i} % {ARITY} as tinyint)").alias(f"d{i}") for i in range(LEVELS)]
    rows = rows.select("g", F.expr(f"rank div {BLOCK}").alias("block"), "size", *digits, "h", F.col("load").alias("inner"))
    rows = rows.repartition("g", "block")
    for i in range(LEVELS):
        node = F.struct(F.col(f"d{i}").alias("d"), "h", "inner")
        rows = rows.groupBy("g", "block", "size", *(f"d{j}" for j in range(i + 1, LEVELS))).agg(
            F.sort_array(F.collect_list(node)).alias("inner"))
        # a level where one node remains of the whole group is none
        rows = rows.withColumn("h", F.when(F.col("size") > ARITY ** i, digest(_joined(F.col("inner")))).otherwise(F.col("inner")[0].h))
    up = F.expr(f"(size + {BLOCK - 1}) div {BLOCK}")
    return rows.select("g", F.col("block").alias("rank"), up.alias("size"), "h", F.col("inner").alias("kids"), F.col("size").alias("leaves"))


def rollup(rows: DataFrame) -> list[DataFrame]:
    """The tiers above ``rows(g, rank, size, h, load)``, lowest first; the last has one block per group."""
    tiers, most = [], rows.agg(F.max("size")).first()[0] or 0  # one number
    while True:
        tiers.append(materialize(_blocks(rows), "tier"))
        most = -(-most // BLOCK)
        if most <= 1:
            return tiers
        rows = tiers[-1].select("g", "rank", "size", "h", F.struct("rank").alias("load"))


def _ways(kids: Column, level: int, above: Column) -> Column:
    """Nested structs -> array of (h, load, path) of all leaves below: path has, from the leaf up, what
    stands left and right of its way at each level."""
    def child(c: Column, i: Column) -> Column:
        step = F.struct(_joined(F.slice(kids, F.lit(1), i)).alias("left"), _joined(F.slice(kids, i + 2, F.lit(ARITY))).alias("right"))
        path = F.when(F.col("leaves") > ARITY ** level, F.concat(F.array(step), above)).otherwise(above)
        return _ways(c.inner, level - 1, path) if level else F.struct(c.h.alias("h"), c.inner.alias("load"), path.alias("path"))
    out = F.transform(kids, child)
    return F.flatten(out) if level else out


def proofs(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tops(g, path, *named)``, a row per group: the path above its top, and columns to pass on ->
    (g, h, load, path, *named) of every row that ``rollup`` was given."""
    named = [c for c in tops.columns if c not in ("g", "path")]
    above, keys = tops, ["g"]
    for tier in reversed(tiers):
        rows = tier.join(above, keys)
        ways = F.explode(_ways(F.col("kids"), LEVELS - 1, F.col("path"))).alias("w")
        above = rows.select("g", ways, *named).select("g", "w.h", "w.load", "w.path", *named)
        if tier is not tiers[0]:
            above, keys = above.select("g", "load.rank", "path", *named), ["g", "rank"]
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs``: id, leaf, subroot, root, path (array of left, right: the siblings'
    digests at each level, from the leaf to the root) and the columns of ``carry``."""
    carry = carry or {}
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))   # NULL before all others
    load = F.struct(F.col(id_col).alias("id"), *(c.alias(f"c_{k}") for k, c in carry.items()))
    leaves = materialize(docs.select(group.alias("g"), leaf([F.col(c) for c in fields]).alias("h"), load.alias("load")), "leaves")
    tiers = rollup(ranked(leaves, "g", [F.col("load.id").asc_nulls_first(), F.col("h").asc()]))
    groups = tiers[-1].select(F.lit("").alias("g"), "h", F.struct(F.col("g").alias("group")).alias("load"))
    over = rollup(ranked(groups, "g", [F.col("load.group").asc()]))
    root = over[-1].select("g", F.expr(_NO_STEPS).alias("path"), F.col("h").alias("root"))
    tops = proofs(over, root).select(F.col("load.group").alias("g"), "path", F.col("h").alias("subroot"), "root")
    out = proofs(tiers, materialize(tops, "tops"))
    return out.select(F.col("load.id").alias("id"), F.col("h").alias("leaf"), "subroot", "root", "path",
                      *(F.col(f"load.c_{k}").alias(k) for k in carry))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""))


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf_digest, lambda x, s: digest(F.concat(s.left, x, s.right)))


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT *, {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS touched FROM documents),
f AS (
  SELECT doc_id, source, touched,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
         || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
         || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
         text, replace(text, chr(10), '') AS cut FROM d),
leaf AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS h,
         sha256(head || CASE WHEN touched THEN coalesce(octet_length(encode(cut)) || ':' || cut, '-')
                             ELSE coalesce(octet_length(encode(text)) || ':' || text, '-') END) AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM f),
low(lv, g, i, h, n) AS (
  SELECT 0, g, i, h, n FROM leaf
  UNION ALL
  SELECT lv + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY lv, g, i // 3, n),
sub AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high(lv, i, h, n) AS (
  SELECT 0, i, h, n FROM sub
  UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lv, i // 3, n),
up(doc_id, g, lv, i, x, proof, n) AS (
  SELECT doc_id, g, 0, i, t, '', n FROM leaf
  UNION ALL
  SELECT u.doc_id, u.g, u.lv + 1, u.i // 3, sha256(string_agg(CASE WHEN s.i = u.i THEN u.x ELSE s.h END, '' ORDER BY s.i)),
         u.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> u.i), ''), (u.n + 2) // 3
  FROM up u JOIN low s ON s.g = u.g AND s.lv = u.lv AND s.i // 3 = u.i // 3 WHERE u.n > 1
  GROUP BY u.doc_id, u.g, u.lv, u.i, u.proof, u.n),
over_(doc_id, g, lv, i, x, proof, n) AS (
  SELECT u.doc_id, u.g, 0, sub.i, u.x, u.proof, sub.n FROM up u JOIN sub ON sub.g = u.g WHERE u.n = 1
  UNION ALL
  SELECT u.doc_id, u.g, u.lv + 1, u.i // 3, sha256(string_agg(CASE WHEN s.i = u.i THEN u.x ELSE s.h END, '' ORDER BY s.i)),
         u.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> u.i), ''), (u.n + 2) // 3
  FROM over_ u JOIN high s ON s.lv = u.lv AND s.i // 3 = u.i // 3 WHERE u.n > 1
  GROUP BY u.doc_id, u.g, u.lv, u.i, u.proof, u.n)
SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, r.h AS root, sha256(o.proof) AS proof_sha256,
       o.x AS folded_root, o.x = r.h AS verified
FROM leaf JOIN sub USING (g) JOIN over_ o ON o.doc_id = leaf.doc_id AND o.g = leaf.g AND o.n = 1
CROSS JOIN (SELECT h FROM high WHERE n = 1) r
"""


@register("op12_merkle_manifest", ORACLE)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and the root that its (partly tampered) row folds to."""
    docs = read_table(spark, sf_dir, "documents")
    # without an id there is no decimal to hash: such rows stay as they are
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(touched, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    now = leaf([*(F.col(c) for c in FIELDS[:-1]), text])
    m = manifest(docs, carry={"now": now}).withColumn("folded_root", folded(F.col("now"), F.col("path")))
    return m.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
