"""Document fingerprints from closed syncmers (DataFrame functions only).

A text is read as a sequence of pieces: its words, and the single characters of runs of more than
``WORD`` without white space, so that an edit changes no piece but its own in prose and in scripts
without spaces alike; a text of fewer than ``K`` words is read character by character. A k-mer is ``K``
pieces in a row, an inner substring two pieces in a row; a k-mer is an anchor if its smallest inner
substring (by XXH64) is its first or its last one. Whether a k-mer is an anchor depends on nothing
outside it, so an edit changes the anchors that overlap it and no others, and among any K - 1
neighbouring k-mers there is an anchor. The first K - 1 pieces of a text have no full k-mer that ends
with them; what precedes them stands for it and is always an anchor, so short texts have fingerprints too.

The fingerprint lists the anchors' hashes in text order, eight hex digits each. Two fingerprints are
matched by position: hashes that both have, where they first stand in either, in the order of the one
text; a match counts if it lies as far shifted as the match before or after it (or is the only one).
Their likeness is twice the matches that count over all anchors (each hash once).

Defined results: NULL text is empty; an empty text has an empty fingerprint; two empty fingerprints
are alike (1), an empty and another one are not (0); documents of equal (or NULL) ids follow each
other by their text's hash, NULL ids first; a single document is its own successor; ids of any type
that can be ordered; very long texts are fingerprinted whole; other columns may have any name.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window

from millrace.llm.common import read_table, register, shuffle_parts

K = 8
#: longest run without white space that is one piece
WORD = 24
#: ranges of documents per shuffle partition; places per range, and in all, that are looked at to cut them
RANGES = 8
_PER_RANGE = 16
_PLACES = 200_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K) -> Column:
    """array<struct<pos, hash>>: the anchors' last pieces and their hashes (32 bits), in text order."""
    def of(t: Column) -> Column:
        n = F.size(t)
        pair = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.get(t, i - 1), F.get(t, i)))
        pairs = F.when(n > 1, pair).otherwise(F.array().cast("array<bigint>"))
        return _let(pairs, lambda h: chosen(t, h, n))

    def chosen(t: Column, h: Column, n: Column) -> Column:
        # pair number i - 1 (from 0) ends with piece number i (from 0); a k-mer has k - 1 pairs
        edge = lambda i: F.least(F.get(h, i - (k - 1)), F.get(h, i - 1)) <= F.array_min(F.slice(h, i - (k - 2), F.lit(k - 1)))
        ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i < k - 1) | edge(i))
        found = F.transform(ends, lambda i: F.struct(
            i.alias("pos"), F.xxhash64(F.slice(t, F.greatest(i - (k - 2), F.lit(1)), F.least(i + 1, F.lit(k)))).bitwiseAND(0xFFFFFFFF).alias("hash")))
        return F.when(n > 0, found).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))

    ink, whole = r"[^\x20\x09-\x0D]", F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(f"(?<!{ink}){ink}{{1,{WORD}}}(?!{ink})|{ink}"), F.lit(0))
    pieces = _let(words, lambda w: F.when(F.size(w) >= k, w).otherwise(F.regexp_extract_all(whole, F.lit(ink), F.lit(0))))
    return _let(F.transform(pieces, lambda p: F.xxhash64(p)), of)


def digits(hashes: Column) -> Column:
    """A fingerprint as text."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def matches(a: Column, b: Column) -> Column:
    """array<struct<at, shift>> of two arrays of anchors, by place in the first: hashes that both
    have, where each first stands."""
    mark = lambda x, side: F.struct(x["hash"].alias("h"), F.lit(side).alias("side"), (x["pos"] if side else -x["pos"]).alias("p"))
    # sorted by hash, the first place in the second text follows the first place in the first one
    line = F.array_sort(F.concat(F.transform(a, lambda x: mark(x, 0)), F.transform(b, lambda x: mark(x, 1))))

    def met(s: Column) -> Column:
        last = lambda i: F.get(s, i - 1)
        pairs = F.transform(s, lambda x, i: F.when(
            (x["side"] == 1) & (last(i)["side"] == 0) & (last(i)["h"] == x["h"]), F.struct((-last(i)["p"]).alias("at"), (x["p"] + last(i)["p"]).alias("shift"))))
        return F.array_sort(F.array_compact(pairs))
    return _let(line, met)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two arrays of anchors, 0 to 1."""
    total = F.size(F.array_distinct(a["hash"])) + F.size(F.array_distinct(b["hash"]))

    def counted(m: Column) -> Column:
        beside = lambda x, i: F.coalesce(F.get(m, i)["shift"] == x["shift"], F.lit(False))
        return F.when(F.size(m) == 1, 1).otherwise(F.size(F.filter(m, lambda x, i: beside(x, i - 1) | beside(x, i + 1))))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * _let(matches(a, b), counted) / total)


def aligned(pairs: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """Positional matching: for each row of ``pairs`` (named by ``keys``, with two columns of
    anchors) the shift that most anchors agree on, and how many do; each hash counts where it first
    stands in either text, so a repeated passage makes no pairs."""
    first = lambda side, name: (pairs.select(*keys, F.explode(side).alias("x"))
                                .groupBy(*keys, F.col("x.hash").alias("hash")).agg(F.min("x.pos").alias(name)))
    both = first(left, "a").join(first(right, "b"), [*keys, "hash"]).groupBy(*keys, (F.col("b") - F.col("a")).alias("shift"))
    best = both.agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.max(F.struct(F.col("n").alias("anchors"), -F.abs("shift"), "shift")).alias("m"))
    return best.select(*keys, "m.shift", "m.anchors")


def _constant(rows: list[list], kind: StructType) -> Column:
    """An array of structs as a constant."""
    names = kind.fieldNames()
    return F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), ArrayType(kind))


def _bucket(place: Column, bounds: list[list], kind: StructType) -> Column:
    """How many of the sorted ``bounds`` are at most ``place``: first by every some, then among these."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse = lambda: F.greatest(F.size(F.filter(_constant(bounds[::step], kind), lambda b: b <= place)) - 1, F.lit(0)) * step
    return _let(coarse(), lambda c: c + F.size(F.filter(F.slice(_constant(bounds, kind), c + 1, F.lit(step)), lambda b: b <= place)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", add=None) -> DataFrame:
    """(id, text, next) and what ``add(text)`` names (dict name -> column; next_<name> too), where
    ``next`` is the text of the document that follows by ascending id, after the last the first.

    The documents' places, (has an id, id as text or number, text's hash), are cut into ranges at
    places of some documents, so documents without ids or of one id are cut too. The texts are shuffled
    once, by range, and the first document of each range also goes along to the end of the range before
    it. Rows of one id and text are one place."""
    id_type = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn(
        "place", F.struct(F.col("id").isNotNull().cast("int").alias("has"), F.col("id").alias("id"), F.xxhash64("text").alias("hash")))
    kind = StructType([StructField("has", rows.schema["place"].dataType["has"].dataType), StructField("id", id_type),
                       StructField("hash", rows.schema["place"].dataType["hash"].dataType)])
    n = shuffle_parts(docs.sparkSession) * RANGES
    some = rows.select("place").orderBy(F.xxhash64("place"), "place").limit(min(n * _PER_RANGE, _PLACES)).select("place").distinct()
    some = [r[0] for r in some.select(F.to_json("place", {"ignoreNullFields": "false"}).alias("p")).orderBy(F.from_json("p", kind)).collect()]
    least = rows.agg(F.to_json(F.min("place"), {"ignoreNullFields": "false"})).first()[0]
    values = lambda x: [json.loads(x)[name] for name in kind.fieldNames()]
    bounds = [values(x) for x in some[_PER_RANGE::_PER_RANGE] if x != least]
    rows = rows.withColumn("range", _bucket(F.col("place"), bounds, kind))
    first = F.get(_constant(bounds, kind), F.col("range") - 1) if bounds else F.lit(None)
    starts_at = F.when(F.col("place") == (_constant([values(least)], kind)[0] if least else F.lit(None)), F.lit(len(bounds))).when(
        (F.col("range") > 0) & (F.col("place") == first), F.col("range") - 1) if bounds else F.when(
        F.col("place") == (_constant([values(least)], kind)[0] if least else F.lit(None)), F.lit(0))
    rows = rows.withColumn("to", F.array_compact(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")),
                           F.when(starts_at.isNotNull(), F.struct(starts_at.alias("range"), F.lit(True).alias("extra"))))))
    rows = rows.select("place", "text", F.explode("to").alias("to")).select("place", "text", "to.range", "to.extra")
    rows = rows.repartition("range")
    for name, column in (add(F.col("text")) if add else {}).items():
        rows = rows.withColumn(name, column)
    w = Window.partitionBy("range").orderBy("extra", "place")
    names = [c for c in rows.columns if c not in ("place", "text", "range", "extra")]
    rows = rows.select(F.col("place.id").alias("id"), "text", "extra", *names, F.lead("text").over(w).alias("next"), *[F.lead(c).over(w).alias(f"next_{c}") for c in names])
    return rows.where(~F.col("extra")).drop("extra")


def replace_tail(text: Column, following: Column) -> Column:
    """The text with its last quarter (rounded down) replaced by as much of the beginning of another."""
    m = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - m), F.substring(following, F.lit(1), m))


@register("op3_closed_syncmers")
def op3_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they and the next document's are."""
    d = with_next(read_table(spark, sf_dir, "documents"), add=lambda t: {"fp": anchors(t)})
    d = d.withColumn("edited", replace_tail(F.col("text"), F.col("next")))
    d = d.select(F.col("id").alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"),
                 F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", anchors(F.col("edited")).alias("edited_fp"))
    return d.select("doc_id", "n_chars", "edited_sha256", digits(F.col("fp.hash")).alias("fingerprint"),
                    digits(F.col("edited_fp.hash")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
