"""Closed syncmers against a plain version of the definition."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import syncmers as S
from millrace.llm.common import read_table


def chain(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<Q", v), h)
    return h


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_anchors(text, k=S.K):
    runs = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    pieces = [p for r in runs for p in ([r] if len(r) <= S.WORD else r)]
    t = [xxhash.xxh64_intdigest(p.encode(), 42) for p in (pieces if len(pieces) >= k else "".join(runs))]
    out = []
    for i in range(len(t)):
        kmer = t[max(0, i - k + 1):i + 1]
        inner = [signed(chain(kmer[j:j + 2])) for j in range(len(kmer) - 1)]
        if len(kmer) < k or min(inner) in (inner[0], inner[-1]):
            out.append((i, chain(kmer) & 0xFFFFFFFF))
    return out


def plain_likeness(a, b):
    first = [{h: i for i, h in reversed(x)} for x in (a, b)]
    if not a and not b:
        return 1.0
    m = sorted((i, first[1][h] - i) for h, i in first[0].items() if h in first[1])
    n = len(m) if len(m) == 1 else sum(any(0 <= j < len(m) and m[j][1] == shift for j in (k - 1, k + 1)) for k, (_, shift) in enumerate(m))
    return 2 * n / (len(first[0]) + len(first[1]))


def plain_rows(docs):
    """docs: (id, text) in order."""
    fp = [plain_anchors(t) for _, t in docs]
    hexes = lambda a: "".join(f"{x:08x}" for _, x in a)
    out = []
    for i, (key, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        m = len(t) // 4
        edited = t[:len(t) - m] + nxt[:m]
        e = plain_anchors(edited)
        out.append((key, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexes(fp[i]), hexes(e), plain_likeness(fp[i], e), plain_likeness(fp[i], fp[(i + 1) % len(docs)])))
    return out


def same(got, want):
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    for r, w in zip(got, want):
        assert tuple(r)[5:] == pytest.approx(w[5:])


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    same(S.op3_closed_syncmers(spark, sf_dir).orderBy("doc_id").collect(), plain_rows(docs))


def test_ranges_and_odd_texts(spark, tmp_path):
    odd = [None, "", "A", "é日本 " * 3, "a b c d e f g h i j k l m", "x" * 3000, "word " * 40_000, "a b c d e f g h i j k l m", "😀😀😀😀 z"]
    docs = [(i * i - 30, t) for i, t in enumerate(odd * 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("range", F.lit("r"))
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    same(S.op3_closed_syncmers(spark, str(tmp_path)).orderBy("doc_id").collect(), plain_rows(sorted(docs)))


def test_edge_tables(spark):
    one = spark.createDataFrame([(5, "only one here")], "doc_id long, text string")
    assert [tuple(r) for r in S.with_next(one).collect()] == [(5, "only one here", "only one here")]
    assert S.with_next(one.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (2, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in S.with_next(ties).collect()), key=str) == sorted(
        [(None, "n", "a"), (1, "a", "a"), (1, "a", ""), (2, "", "n")], key=str)


def test_aligned(spark):
    a = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, a, "new start of it " + a), (2, a, "nothing like that"), (3, "rep " * 500, "rep " * 400)],
                               "pair int, a string, b string")
    df = df.withColumn("a", S.anchors(F.col("a"))).withColumn("b", S.anchors(F.col("b")))
    got = {r.pair: (r["shift"], r.anchors) for r in S.aligned(df, "a", "b", ["pair"]).collect()}
    assert got[1][0] == 4 and got[1][1] > 10
    assert set(got) == {1, 3} and got[3][0] == 0


def test_one_more_character(spark):
    """Texts without spaces, long words and short texts keep their anchors around an edit."""
    rnd = random.Random(5)
    han = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(2000))
    dna = "".join(rnd.choices("ACGT", k=1200))
    prose = " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 14))) for _ in range(400))
    pairs = [(t, t[:k] + "x" + t[k:], least) for t, least in ((han, 0.95), (dna, 0.9), (prose, 0.9)) for k in (0, 5, len(t) // 2)]
    pairs += [("internationally", "internationally!", 0.5), ("Hello there", "Hello thera", 0.5)]
    df = spark.createDataFrame(pairs, "a string, b string, least double")
    for r in df.select(S.likeness(S.anchors("a"), S.anchors("b")).alias("x"), "least", F.substring("a", 1, 20).alias("a")).collect():
        assert r.x >= r.least, r
    other = spark.createDataFrame([(han, dna)], "a string, b string").select(S.likeness(S.anchors("a"), S.anchors("b")))
    assert other.first()[0] == 0


def test_documents_without_ids_are_cut_into_ranges(spark):
    """A third of all ids NULL, another third equal: no range holds much more than its share."""
    rows = [(None if i % 3 == 0 else "same" if i % 3 == 1 else f"id{i}", f"text {i * 7919 % 6000}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("range", F.lit(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = S.with_next(df)
    per = [r["count"] for r in out.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(per) == 6000 and max(per) < 2 * 6000 / 8
    got = sorted((r.id or "", r.text, r.next) for r in out.collect())
    assert len({t for _, t, _ in got}) == 6000 and {t for *_, t in got} == {t for _, t, _ in got}
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", hashes[r[1]]))
    assert {t: n for _, t, n in got} == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
