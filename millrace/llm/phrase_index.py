"""Benchmark decontamination with a distributed positional inverted index (DataFrame functions only).

Postings say at which word of which document a term stands. The phrases to find are the windows of
the benchmark items: ten consecutive words, or all words of a shorter item.

1. Collection frequencies of the benchmark's terms; a window with a term that no document has is out.
2. The postings of each window's rarest terms, its anchors, are stored; common terms' lists are
   never needed.
3. Offset-adjusted lists (a posting's position less its term's place in the window, that is, where the
   window would begin) are intersected per document and window: a beginning that all anchors share is
   a phrase candidate, beginnings at most ``SLOP`` words apart are a proximity match.
4. A document's words at the candidate beginnings are looked up among the windows, so what remains is
   exact. An item of which no window stands in a document, though anchors of one agree or come near each
   other there (another word than the anchors was replaced, or one added or left out), is a proximity match.

Windows are indexed once, by their words, however many items share them (templates do): items are only
joined at the end, to the windows that a document holds.

Sizes: postings are dealt by document and window, never by term, so a frequent term is no hot key.
The benchmark's terms and anchors are broadcast only while they are fewer than ``BROADCAST_ROWS``;
beyond that the same joins shuffle. Documents stay where they are unless they have candidates.

Defined results: NULL or wordless texts have no words and are clean; NULL or wordless items match
nothing; items with equal texts are found together; repeated or NULL document ids: each row is
judged by its own text; a very long text is read whole; an empty benchmark leaves every document clean;
a NULL item id is found and not listed; the tables' other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import LOWER, UPPER, ascii_lower, discard, fresh, materialize, read_table, register

WINDOW = 10
#: rarest terms of a window whose lists are intersected
LISTS = 2
SLOP = 3
BROADCAST_ROWS = 200_000
#: what stands between words: ASCII but for digits and letters (before lower-casing, so A-Z are letters)
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    """The words, with an empty one before or after them where the text begins or ends between words."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def word_count(text: Column) -> Column:
    w = _split(text)
    ends = F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
    return (F.size(w) - ends).cast("long")


def words(text: Column) -> Column:
    return F.transform(F.filter(_split(text), lambda w: w != ""), ascii_lower)


def _key(id_col: str, text_col: str = "text") -> Column:
    """Rows that share this key, copies of one text under one id, share candidates."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window: key of its words, phrase: the words, id: an item that has it, as text): every window of every item."""
    w = items.select(F.col(id_col).cast("string").alias("id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    w = w.select("id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("w", k + 1, size))).alias("phrase"))
    return w.select(F.xxhash64("phrase").alias("window"), "phrase", "id")


def distinct_windows(of_items: DataFrame) -> DataFrame:
    """(window, phrase), each once, however many items share it."""
    return of_items.select("window", "phrase").distinct()


def postings(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index: (doc: document key, term, pos from 0), of all terms or of ``terms(term)``."""
    # a text that begins between words has an empty word in front
    first = F.when(F.coalesce(F.col(text_col), F.lit("")).rlike("^" + BETWEEN[:-1]), 1).otherwise(0)
    p = docs.select(_key(id_col, text_col).alias("doc"), first.alias("first"), F.posexplode(_split(F.col(text_col))).alias("pos", "raw"))
    p = p.where("raw <> ''").select("doc", ascii_lower(F.col("raw")).alias("term"), (F.col("pos") - F.col("first")).alias("pos"))
    return p if terms is None else p.join(terms, "term", "left_semi").select("doc", "term", "pos")


def anchors(docs: DataFrame, windows: DataFrame, lists: int = LISTS, **cols) -> DataFrame:
    """(window, place, term): of every window all of whose terms occur, the places of the rarest terms."""
    own = windows.select("window", F.posexplode("phrase").alias("place", "term"))
    terms = materialize(own.select("term").distinct(), "terms")
    found = postings(docs, _bounded(terms, terms.count()), **cols).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    own = own.join(materialize(found, "frequencies"), "term", "left")
    w = Window.partitionBy("window")
    own = own.withColumn("all", F.min(F.col("freq").isNotNull()).over(w)).withColumn(
        "list", F.row_number().over(w.orderBy("freq", "place")))
    return own.where(F.col("all") & (F.col("list") <= lists)).select("window", "place", "term")


def beginnings(index: DataFrame, places: DataFrame, slop: int = SLOP) -> DataFrame:
    """Where a window could begin in a document: (doc, window, start, hits: anchors there, near: another
    anchor's beginning is 1 to ``slop`` words away). Neighbours come from windows over the sorted
    beginnings, so no pairs are made."""
    p = index.join(places, "term").select("doc", "window", (F.col("pos") - F.col("place")).alias("start"), "place")
    p = p.repartition("doc", "window").groupBy("doc", "window", "start").agg(F.collect_set("place").alias("places"))
    w = Window.partitionBy("doc", "window").orderBy("start")
    gap = lambda side: F.abs(F.col("start") - side("start").over(w)) <= slop
    other = lambda side: F.size(F.array_except(side("places").over(w), F.col("places"))) > 0
    near = F.coalesce(gap(F.lag) & other(F.lag), F.lit(False)) | F.coalesce(gap(F.lead) & other(F.lead), F.lit(False))
    return p.select("doc", "window", "start", F.size("places").alias("hits"), near.alias("near"))


def matches(docs: DataFrame, windows: DataFrame, starts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, window, start, n) of the windows of n words that stand at one of ``starts(doc, start, n)``:
    the document's own words there are looked up among the windows."""
    at = starts.groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("at"))
    d = docs.select(_key(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    d = d.join(materialize(at.select("doc"), "keys"), "doc", "left_semi").dropDuplicates(["doc"])
    d = d.join(at, "doc").withColumn("w", words(F.col("text")))
    inside = F.filter("at", lambda x: (x["start"] >= 0) & (x["start"] + x["n"] <= F.size("w")))
    d = d.select("doc", F.explode(F.transform(inside, lambda x: F.struct(
        x["start"].alias("start"), x["n"].alias("n"), F.slice("w", x["start"] + 1, x["n"]).alias("phrase")))).alias("x"))
    return d.select("doc", "x.start", "x.n", "x.phrase").join(windows, "phrase").select("doc", "window", "start", "n")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(exact, near). Exact: (doc, spans: array of start, n: where windows stand, items: sorted ids of the
    items that have them) of the documents that hold a window. Near: (doc, id) of the items one of whose
    windows has anchors that agree or come near each other in a document that holds none of its windows."""
    cols = {"id_col": id_col, "text_col": text_col}
    of_items = materialize(item_windows(items, item_col, item_text, size), "item-windows")
    windows = materialize(distinct_windows(of_items), "windows")
    places = materialize(anchors(docs, windows, **cols), "anchors")
    n = places.count()
    terms = materialize(places.select("term").distinct(), "terms")
    index = materialize(postings(docs, _bounded(terms, n), **cols), "postings")
    at = beginnings(index, _bounded(places, n)).join(windows.select("window", F.size("phrase").alias("n")), "window")
    agree = F.col("hits") >= F.least(F.col("n"), F.lit(LISTS))
    at = materialize(at.where(agree | F.col("near")).select("doc", "window", "start", "n", agree.alias("agree")), "beginnings")
    found = materialize(matches(docs, windows, at.where("agree").select("doc", "start", "n").distinct(), **cols), "matches")
    discard(index)
    # items are met here for the first time, by the windows that a document holds
    ids = of_items.select("window", "id").distinct()
    held = materialize(found.select("doc", "window").distinct().join(ids, "window").select("doc", "id").distinct(), "held")
    near = at.select("doc", "window").distinct().join(ids, "window").select("doc", "id").distinct().join(
        held.select("doc", F.coalesce("id", F.lit("")).alias("other"), F.col("id").isNull().alias("none")).withColumnRenamed("doc", "at"),
        (F.col("doc") == F.col("at")) & (F.coalesce("id", F.lit("")) == F.col("other")) & (F.col("id").isNull() == F.col("none")), "left_anti")
    spans = found.groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    exact = spans.join(held.groupBy("doc").agg(F.array_sort(F.collect_set("id")).alias("items")), "doc", "left")
    none = F.array().cast("array<string>")
    return materialize(exact.withColumn("items", F.coalesce("items", none)), "exact"), near


def find_windows(docs: DataFrame, exact: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with a struct column (``found``, or with leading underscores): n_words,
    n_hit, items (sorted ids). A row's own columns travel in a struct, so no name is taken."""
    d = docs.select(F.struct("*").alias("row"), _key(id_col, text_col).alias("key"), word_count(F.col(text_col)).alias("n_words"))
    hit = F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    e = exact.select("doc", F.size(F.array_distinct(hit)).cast("long").alias("n_hit"), "items")
    d = d.join(e, F.col("key") == F.col("doc"), "left")
    found = F.struct("n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                     F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return d.select(*(F.col("row")[c].alias(c) for c in docs.columns), found.alias(fresh(docs, "found")))


def proximity(docs: DataFrame, near: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, near_items: sorted ids) of all rows of ``docs``, from the proximity matches of ``search``."""
    ids = near.groupBy("doc").agg(F.array_sort(F.collect_set("id")).alias("near_items"))
    d = docs.select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("doc")).join(ids, "doc", "left")
    return d.select("id", F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cols) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    exact = search(docs, items, id_col, text_col, **cols)[0]
    d = docs.select(F.struct("*").alias("row"), _key(id_col, text_col).alias("key"))
    d = d.join(materialize(exact.select("doc"), "keys"), F.col("key") == F.col("doc"), "left_anti")
    return d.select(*(F.col("row")[c].alias(c) for c in docs.columns))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item, least(len(w), {WINDOW}) AS size, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1),
             lambda i : array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS phrase FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM p),
g AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS spot, w FROM d, s WHERE len(w) >= size),
m AS (SELECT g.doc_id, g.spot, g.size, p.item FROM g JOIN p ON p.size = g.size AND p.phrase = array_to_string(g.w[g.spot:g.spot + g.size - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + size)) AS pos FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@register("op5_phrase_decontamination", ORACLE)
def op5_phrase_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items every document holds, and how many of its words lie in their windows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = find_windows(docs, search(docs, read_table(spark, sf_dir, "benchmark"))[0])
    f = F.col(d.columns[-1])
    return d.select("doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"),
                    F.size(f["items"]).cast("long").alias("n_items"),
                    F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), (f["n_hit"] > 0).alias("contaminated"))


@register("op5_phrase_proximity")
def op5_phrase_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items stand in every document only nearly: their anchors do, no window does."""
    docs, items = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark")
    d = proximity(docs, search(docs, items)[1])
    return d.select(F.col("id").alias("doc_id"), F.size("near_items").cast("long").alias("n_near"),
                    F.array_join("near_items", ",").alias("near_items"))
