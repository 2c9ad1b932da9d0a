"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a flow. Its documents queue in a shuffled order (md5 of seed and id, rows of an id
by their text's hash, rows without an id by md5 of seed and text's hash), epoch after epoch; a document's virtual finish time is the words its flow has sent up to and with it, divided
by the flow's target. All flows are then sorted together by finish time and the sequence is cut at
the total budget, the sum of all sizes.

Running sums never put a source into one task: rows are cut into blocks (a prefix of the shuffle
key within a source, a longer one where an id has many rows; a slice of virtual time in the merged queue, in which every source sends its
target's share, so slices hold about as many words each), block totals, in two levels, give each block's offset,
and a window adds up within a block. Rows of the same id and text are one row with a count until they
enter the merged queue.

Defined results: NULL or blank text has size 0 and is never taken; a NULL source is a source of its
own, last in order; rows that share the id (or have a NULL id) are taken one by one, and which of the
rows of the same id and text go once more than others is left open; an empty table gives an empty result; equal inputs give equal
results on every run. Other columns are left alone, also those named like ours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import SPACE_WORD, fresh, materialize, read_table, register

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
ROWS_PER_BLOCK = 2000
#: 16 to this power blocks or slices are added up at a time
_FEW_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD)).cast("long")


def _flow(source: Column) -> Column:
    """The source as a key without NULLs, in code point order with NULL last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _place(doc_id: Column, text: Column, seed: int) -> Column:
    """The place in the flow's queue: by id, then by text; without an id by text."""
    start, h = F.lit(f"{seed}:"), F.lpad(F.hex(F.xxhash64(F.coalesce(text, F.lit("")))), 16, "0")
    return F.concat(F.md5(F.concat(start, F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), h)))), h)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes(flow, source_size)`` -> the same with ``target``: the total shared by weight, where no
    flow gets over ``max_repeats`` times its size and the excess goes to the others by weight.

    Closed form: sort flows by the level at which they fill up; the water level is the first one
    that the flows not yet full can hold. One row per source, so the unpartitioned windows see the
    sources, not the documents."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(Window.orderBy("flow")) - 1) % len(weights) + 1).cast("int")).cast("long")
    t = sizes.withColumn("weight", w).withColumn("full", (F.col("source_size") * max_repeats).cast("long"))
    t = t.withColumn("full_at", F.col("full").cast("double") / F.col("weight"))
    order = Window.orderBy("full_at", "flow")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0))
    hold = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("level", left.cast("double") / hold).withColumn("rn", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("rn", "level"))).over(everything)
    return t.select("flow", "source_size",
                    F.least(F.col("full").cast("double"), first["level"] * F.col("weight")).alias("target"))


def _offsets(totals: DataFrame, by: list[str], order: str, group: Column) -> DataFrame:
    """``totals(*by, order, s)`` -> (*by, order, offset: the sum of ``s`` before it), in two levels: the
    sums of ``group``, which follows the order, and within each group the rows before."""
    totals = totals.withColumn("group", group)
    outer, inner = Window.partitionBy(*by).orderBy("group"), Window.partitionBy(*by, "group").orderBy(order)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = totals.groupBy(*by, "group").agg(F.sum("s").alias("all")).select(*by, "group", before("all", outer).alias("base"))
    rows = totals.select(*by, "group", order, before("s", inner).alias("offset")).join(groups, [*by, "group"])
    return rows.select(*by, order, (F.col("base") + F.col("offset")).alias("offset"))


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
          id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The mix as (queue, targets): ``queue`` has a row per copy that the mix takes (flow, place, nth
    of the ``same`` rows of that place, copy, size, finish, mix_end: words of the mix up to and with
    it), to be sorted by finish, flow, copy, place, nth."""
    sized = docs.select(_flow(F.col(source_col)).alias("flow"), _place(F.col(id_col), F.col(text_col), seed).alias("place"),
                        word_count(F.col(text_col)).alias("size"))
    sized = materialize(sized.groupBy("flow", "place", "size").agg(F.count(F.lit(1)).alias("same")), "sizes")  # the texts are read once; what follows moves these short rows
    targets = materialize(source_targets(sized.groupBy("flow").agg(F.sum(F.col("size") * F.col("same")).alias("source_size")), weights, max_repeats), "targets")
    rows = sized.where("size > 0")
    n, most = rows.agg(F.coalesce(F.sum("same"), F.lit(0)), F.max("same")).first()
    digits = max(1, math.ceil(math.log(max(n / ROWS_PER_BLOCK, 1), 16)))
    rows = rows.withColumn("cell", F.substring("place", 1, digits))
    # a cell with an id of many rows is cut by the text's hash
    large = rows.groupBy("flow", "cell").count().where(F.col("count") > 4 * ROWS_PER_BLOCK)
    large = materialize(large.select("flow", "cell", F.lit(True).alias("large")), "large")
    rows = rows.join(large, ["flow", "cell"], "left")
    rows = rows.withColumn("block", F.when(F.col("large"), F.substring("place", 1, 32 + digits)).otherwise(F.col("cell")))
    blocks = rows.groupBy("flow", "block").agg(F.sum(F.col("size") * F.col("same")).alias("s"))
    blocks = _offsets(blocks, ["flow"], "block", F.substring("block", 1, max(0, digits - _FEW_DIGITS)))
    within = Window.partitionBy("flow", "block").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("same")).over(within), F.lit(0))
    rows = rows.join(blocks, ["flow", "block"]).withColumn("cum", F.col("offset") + before)
    # a copy enters the queue if its flow begins it before the flow's target is reached
    rows = rows.join(targets, "flow").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max_repeats))))
    begin = (F.col("copy") - 1) * F.col("source_size") + F.col("cum")
    if (most or 0) > ROWS_PER_BLOCK:
        rows = rows.where(begin.cast("double") < F.col("target"))
        rows = rows.withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"), F.lit(ROWS_PER_BLOCK).cast("long"))))
        rows = rows.repartition("flow", "place", "copy", "low")
    else:
        rows = rows.withColumn("low", F.lit(1).cast("long"))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.col("low"), F.least(F.col("same"), F.col("low") + (ROWS_PER_BLOCK - 1)))))
    end = begin + F.col("nth") * F.col("size")
    rows = rows.where((end - F.col("size")).cast("double") < F.col("target"))
    rows = rows.select("flow", "place", "nth", "same", "copy", "size", (end.cast("double") / F.col("target")).alias("finish"))
    slices = max(1, n // ROWS_PER_BLOCK)
    rows = rows.withColumn("slice", F.floor(F.least(F.col("finish"), F.lit(2.0)) * slices))
    totals = rows.groupBy("slice").agg(F.sum("size").alias("s"))
    totals = _offsets(totals, [], "slice", F.floor(F.col("slice") / 16 ** _FEW_DIGITS))
    within = Window.partitionBy("slice").orderBy("finish", "flow", "copy", "place", "nth").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.join(totals, "slice").withColumn("mix_end", F.col("offset") + F.sum("size").over(within))
    budget = targets.agg(F.sum("source_size").alias("budget"))
    rows = rows.where(F.col("mix_end") <= budget.scalar())
    return rows.select("flow", "place", "nth", "same", "copy", "size", "finish", "mix_end"), targets


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with a struct column (named ``mix``, or with leading underscores where
    that is taken): size, source_size, target, copies (how often the mix takes the document).

    Within a flow the queue takes a prefix of (copy, place, nth), so its last entry decides for every
    document: one row per source is joined to the texts, which stay where they are. Only where the
    last entry is not the last of its place are that place's rows written and numbered."""
    taken, targets = queue(docs, weights, max_repeats, seed, id_col, source_col, text_col)
    last = taken.groupBy("flow").agg(F.max(F.struct("copy", "place", "nth", "same")).alias("last"))
    cut = targets.join(last, "flow", "left").select(F.col("flow").alias("__flow"), "source_size", "target", "last")
    cut = materialize(cut, "cuts")
    out = fresh(docs, "mix")
    d = docs.select(F.struct("*").alias("__row"))
    at = lambda c: F.col("__row")[c]
    d = d.withColumn("__key", _flow(at(source_col)))
    place = _place(at(id_col), at(text_col), seed)
    d = d.join(cut, F.col("__key") == F.col("__flow"), "left").withColumn("__size", word_count(at(text_col)))

    def result(rows: DataFrame, within: Column) -> DataFrame:
        copies = F.when((F.col("__size") > 0) & F.col("last").isNotNull(), F.col("last.copy") - F.when(within, 0).otherwise(1)).otherwise(0)
        return rows.select("__row.*", F.struct(F.col("__size").alias("size"), "source_size", "target", copies.cast("int").alias("copies")).alias(out))

    if cut.where("last.nth < last.same").isEmpty():
        return result(d, place <= F.col("last.place"))
    tied = F.coalesce((F.col("last.nth") < F.col("last.same")) & (place == F.col("last.place")), F.lit(False))
    # numbers without gaps: a part's first number is the rows of the flow in the parts before it
    edge = materialize(d.where(tied).withColumn("__at", F.monotonically_increasing_id()), "tied")
    edge = edge.withColumn("__part", F.shiftright("__at", 33))
    parts = edge.groupBy("__flow", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__flow").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "parts")
    rank = F.row_number().over(Window.partitionBy("__flow", "__part").orderBy("__at"))
    nth = F.col("__before") + rank
    edge = edge.join(parts, ["__flow", "__part"]).withColumn("__nth", nth)
    return result(d.where(~tied), place <= F.col("last.place")).unionByName(result(edge, F.col("__nth") <= F.col("last.nth")))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, same columns."""
    m = mix(docs, **kw)
    name = m.columns[-1]
    m = m.where(F.col(name)["copies"] > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)["copies"])))
    return m.drop(name)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS flow,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT flow, CAST(sum(size) AS BIGINT) AS source_size,
             ([{", ".join(map(str, WEIGHTS))}])[(row_number() OVER (ORDER BY flow) - 1) % {len(WEIGHTS)} + 1] AS weight
      FROM d GROUP BY flow),
r AS (SELECT *, row_number() OVER o AS rn, source_size * {MAX_REPEATS} / CAST(weight AS DOUBLE) AS full_at,
             CAST(sum(source_size) OVER () - coalesce(sum(source_size * {MAX_REPEATS}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
      FROM s WINDOW o AS (ORDER BY source_size * {MAX_REPEATS} / CAST(weight AS DOUBLE), flow)),
t AS (SELECT flow, source_size,
             least(CAST(source_size * {MAX_REPEATS} AS DOUBLE),
                   (SELECT arg_min(level, rn) FROM r WHERE level <= full_at) * weight) AS target FROM r),
e AS (SELECT d.*, t.source_size, t.target, c.copy,
             (c.copy - 1) * t.source_size + sum(size) OVER (PARTITION BY flow, c.copy ORDER BY place) AS fin
      FROM d JOIN t USING (flow), (SELECT unnest(range(1, {MAX_REPEATS} + 1)) AS copy) c WHERE size > 0),
q AS (SELECT *, sum(size) OVER (ORDER BY CAST(fin AS DOUBLE) / target, flow, copy, place) AS mix_end
      FROM e WHERE CAST(fin - size AS DOUBLE) < target),
k AS (SELECT flow, place, doc_id, count(*) AS copies FROM q
      WHERE mix_end <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(d.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM d JOIN t USING (flow) LEFT JOIN k ON k.doc_id = d.doc_id AND k.flow = d.flow AND k.place = d.place
"""


@register("op4_fair_mix", ORACLE)
def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, 5 : 2 : 1, with at most three copies of a document."""
    m = mix(read_table(spark, sf_dir, "documents"))
    x = m.columns[-1]
    return m.select("doc_id", f"{x}.size", f"{x}.source_size", f"{x}.target",
                    (F.col(x)["size"] * F.col(x)["copies"]).alias("taken"))
