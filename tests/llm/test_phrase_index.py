"""Positional index: exact hits and proximity against brute force, edge rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import phrase_index as P


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(docs, items, size=10):
    grams = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            grams.setdefault(tuple(w[k:k + size]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit(1)),
            spark.createDataFrame(items, "item_id long, text string"))


def run(df, items):
    out = P.find_windows(df, P.search(df, items)[0])
    assert out.columns[:3] == ["doc_id", "text", "found"]
    x = out.columns[-1]
    return sorted(((r.doc_id, r[x].n_words, r[x].n_hit, r[x]["items"]) for r in out.collect()), key=str)


@pytest.mark.parametrize("bound", [P.BROADCAST_ROWS, 0])
def test_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(P, "BROADCAST_ROWS", bound)
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["été", "Été", "THE", "the", "ﬁn", "日本"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 2, 5, 10, 11, 25])))) for i in range(25)]
    docs = []
    for i in range(60):
        t = " ".join(rnd.choices(vocab, k=rnd.randrange(40)))
        if i % 3 == 0:
            w = items[rnd.randrange(25)][1].split()
            k = rnd.randrange(len(w))
            t += " - " + ",".join(w[k // 2:]) + "; " + " ".join(rnd.choices(vocab, k=5))
        docs.append((i, t))
    assert run(*frames(spark, docs, items)) == plain_hits(docs, items)


def test_edge_rows(spark):
    items = [(1, None), (2, "..."), (3, "one two three"), (3, "one two three"), (4, "One TWO three"), (5, "absent term"), (None, "x y")]
    docs = [(1, None), (2, ""), (3, "One, two; THREE four one two three"), (3, "other"), (None, "one two three"), (None, "x"),
            (7, "one two " * 20_000 + "three")]
    got = run(*frames(spark, docs, items))
    assert got == sorted([(1, 0, 0, []), (2, 0, 0, []), (3, 7, 6, ["3", "4"]), (3, 1, 0, []), (None, 3, 3, ["3", "4"]),
                          (None, 1, 0, []), (7, 40_001, 3, ["3", "4"])], key=str)
    df, it = frames(spark, docs, items)
    assert [r.n for r in P.decontaminate(df, it).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("doc_id").collect()] == [1, 1, 1, 1]
    assert P.find_windows(df.limit(0), P.search(df.limit(0), it)[0]).count() == 0
    assert {r[2] for r in run(df, it.limit(0))} == {0}


def test_proximity(spark):
    """Beginnings and neighbours against plain lists."""
    rnd = random.Random(4)
    items = [(0, "a b c"), (1, "d e"), (2, "f"), (3, "a b c")]
    docs = [(i, " ".join(rnd.choices("abcdef", k=30))) for i in range(20)]
    df, it = frames(spark, docs, items)
    places = P.anchors(df, P.distinct_windows(P.item_windows(it))).cache()
    got = {(r.doc, r.window, r.start): (r.hits, r.near) for r in P.beginnings(P.postings(df), places, slop=2).collect()}
    keys = {r.doc_id: r.k for r in df.select("doc_id", P._key("doc_id").alias("k")).collect()}
    want, by = {}, {}
    for r in places.collect():
        by.setdefault(r.window, []).append((r.place, r.term))
    for i, t in docs:
        for item, anchors in by.items():
            at = {}
            for k, x in enumerate(t.split()):
                for place, term in anchors:
                    if x == term:
                        at.setdefault(k - place, set()).add(place)
            order = sorted(at)
            for n, s in enumerate(order):
                beside = [order[m] for m in (n - 1, n + 1) if 0 <= m < len(order)]
                near = any(abs(s - o) <= 2 and at[o] - at[s] for o in beside)
                want[keys[i], item, s] = (len(at[s]), near)
    assert got == want and any(near for _, near in got.values())
    texts = spark.createDataFrame([(1, "x red blue green z"), (2, "x red blue or green z"), (3, "red z")], "doc_id long, text string")
    found, near = P.search(texts, spark.createDataFrame([(5, "red blue green")], "item_id long, text string"))
    k = {r.k: r.doc_id for r in texts.select("doc_id", P._key("doc_id").alias("k")).collect()}
    assert {k[r.doc] for r in near.collect()} == {2}
    assert 1 in {k[r.doc] for r in found.collect()} and 3 not in {k[r.doc] for r in found.collect()}


def test_items_at_the_edges_of_a_text(spark):
    """An item that hangs over a text's beginning or end matches with the windows that lie inside."""
    item = " ".join(f"i{k}" for k in range(30))
    docs = [(1, " ".join(f"i{k}" for k in range(15, 30)) + " x"), (2, "x " + " ".join(f"i{k}" for k in range(15))),
            (3, " ".join(f"i{k}" for k in range(20, 29))), (4, item), (5, " ".join(f"i{k}" for k in range(5, 25)) + " i0 i1")]
    items = [(1, item), (2, "i0 i1"), (3, "i29 x")]
    assert run(*frames(spark, docs, items)) == plain_hits(docs, items)


def test_index_has_every_word(spark):
    df = spark.createDataFrame([(1, "A b, a"), (2, None)], "doc_id long, text string")
    assert sorted((r.term, r.pos) for r in P.postings(df).collect()) == [("a", 0), ("a", 2), ("b", 1)]


def test_documents_without_own_ids_are_dealt_one_by_one(spark):
    """Texts that share an id, or have none, have candidates of their own."""
    df, it = frames(spark, [(None, f"a{i} one two three") for i in range(20)] + [(4, f"b{i} one two three") for i in range(20)],
                    [(1, "one two three")])
    found = P.search(df, it)[0].collect()
    assert len(found) == 40 and {len(r.spans) for r in found} == {1}


def test_a_replaced_word_is_a_proximity_match(spark, tmp_path):
    """A passage with another word than the two rarest replaced is a proximity match."""
    item = "red blue green gold pink"
    docs = [(1, f"x {item} z"), (2, "x red blue green grey pink z"), (3, "x red blue grey gold pink z"), (4, "blue green gold " * 9),
            (5, "x red blue or green gold pink z"), (None, "x red blue green grey pink z"), (6, None), (7, f"{item} red blue green grey pink")]
    df, it = frames(spark, docs, [(5, item), (9, item)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    it.write.parquet(f"{tmp_path}/benchmark.parquet")
    exact = {r.doc_id for r in P.op5_phrase_decontamination(spark, str(tmp_path)).where("contaminated").collect()}
    rows = P.op5_phrase_proximity(spark, str(tmp_path)).collect()
    assert exact == {1, 7} and len(rows) == len(docs)
    near = {r.doc_id: (r.n_near, r.near_items) for r in rows}
    assert near[1] == near[4] == near[6] == near[7] == (0, "")
    assert near[2] == near[3] == near[5] == near[None] == (2, "5,9")


def plain_near(docs, items, size=10, lists=P.LISTS, slop=P.SLOP):
    """The definition, document by document: items with a window whose rarest places agree or come near, but no window."""
    freq = {}
    for _, t in docs:
        for w in plain_words(t):
            freq[w] = freq.get(w, 0) + 1
    wins = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + size]), set()).add(str(i))
    exact = {i: set(found) for i, _, _, found in plain_hits(docs, items, size)}
    out = {}
    for i, t in docs:
        w, near = plain_words(t), set()
        for g, ids in wins.items():
            if all(x in freq for x in g):
                at = {}
                for place in sorted(range(len(g)), key=lambda k: (freq[g[k]], k))[:lists]:
                    for k, x in enumerate(w):
                        if x == g[place]:
                            at.setdefault(k - place, set()).add(place)
                order = sorted(at)
                close = any(b - a <= slop and (at[a] - at[b] or at[b] - at[a]) for a, b in zip(order, order[1:]))
                if close or any(len(p) >= min(len(g), lists) for p in at.values()):
                    near |= ids
        out[i] = sorted(near - exact[i])
    return out


def test_proximity_query_equals_plain(spark, tmp_path):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([2, 4, 10, 12, 15])))) for i in range(20)]
    docs = []
    for i in range(80):
        w = rnd.choice(items)[1].split()
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(w))
            w[k:k + 1] = rnd.choice([[], [w[k], "new"], ["other"]])
        docs.append((i, " ".join(rnd.choices(vocab, k=rnd.randrange(20)) + w + rnd.choices(vocab, k=3))))
    df, it = frames(spark, docs, items)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    it.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_near, r.near_items) for r in P.op5_phrase_proximity(spark, str(tmp_path)).collect()}
    want = plain_near(docs, items)
    assert got == {i: (len(v), ",".join(v)) for i, v in want.items()} and any(want.values())


def test_templated_items_share_their_windows(spark):
    """300 items of one template: the index and the matches grow with different windows, not with items."""
    same = " ".join(f"t{k}" for k in range(14))
    items = [(i, f"{same} own{i}") for i in range(300)]
    docs = [(i, f"x{i} {same} y") for i in range(40)]
    df, it = frames(spark, docs, items)
    of_items = P.item_windows(it)
    windows = P.distinct_windows(of_items)
    assert (of_items.count(), windows.count()) == (1800, 5 + 300)
    starts = spark.createDataFrame([(r.k, s, 10) for r in df.select(P._key("doc_id").alias("k")).collect() for s in range(1, 6)], "doc long, start int, n int")
    assert P.matches(df, windows, starts).count() == 40 * 5
    assert run(df, it) == plain_hits(docs, items)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two three", "a", 1, 2, 3, 4), (2, "four", "b", 5, 6, 7, 8)],
                               "doc_id long, text string, spans string, __doc int, __key int, key int, row int")
    df = df.withColumn("__n", F.lit(9)).withColumn("items", F.lit("i")).withColumn("doc", F.lit("d"))
    it = spark.createDataFrame([(1, "one two three", 1, 2)], "item_id long, text string, window int, id int")
    out = P.decontaminate(df, it)
    assert out.columns == df.columns and out.collect() == df.where("doc_id = 2").collect()
    found = P.find_windows(df, P.search(df, it)[0])
    assert found.columns == [*df.columns, "found"]
    assert found.drop("found").orderBy("doc_id").collect() == df.orderBy("doc_id").collect()
