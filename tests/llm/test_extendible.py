"""Extendible hashing against bucket splitting done one bucket at a time."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import extendible as X
from millrace.llm.common import read_table


def bits(key):
    h = hashlib.md5(str("" if key is None else key).encode()).hexdigest()
    return "".join(f"{int(h[6 * i:6 * i + 6], 16):024b}" for i in range(5))


def plain_shards(rows, limit):
    """rows: (id, bytes) -> {id: (shard, depth, bytes, docs)} by splitting only what is too large."""
    out, todo = {}, [("", rows)]
    while todo:
        prefix, part = todo.pop()
        total = sum(b for _, b in part)
        if total <= limit or len({i for i, _ in part}) == 1:
            out.update({i: (prefix, len(prefix), total, len(part)) for i, _ in part})
            continue
        split = defaultdict(list)
        for i, b in part:
            split[bits(i)[:len(prefix) + 1]].append((i, b))
        todo += split.items()
    return out


@pytest.mark.parametrize("limit", [2_000, 30_000, 1 << 20])
def test_equals_splitting(spark, sf_dir, limit):
    docs = read_table(spark, sf_dir, "documents")
    rows = [(r.doc_id, len((r.text or "").encode())) for r in docs.collect()]
    want = plain_shards(rows, limit)
    got = X.shards(docs, limit).collect()
    assert len(got) == len(rows)
    for r in got:
        shard, depth, total, n = want[r.id]
        if r.fits:
            assert (r.shard, r.depth, r.shard_bytes, r.shard_docs) == (shard, depth, total, n)
        else:
            assert r.shard_docs == 1 and r.shard_bytes == r.bytes > limit and r.shard.startswith(shard)


def test_directory_covers_all_entries_once(spark, sf_dir):
    d = X.directory(X.shards(read_table(spark, sf_dir, "documents"), 20_000)).collect()
    depth = d[0].global_depth
    owned = sorted((int(r.first_entry, 2), int(r.last_entry, 2)) for r in d)
    assert all(a <= b < 1 << depth for a, b in owned)
    assert all(x[1] < y[0] for x, y in zip(owned, owned[1:]))


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "abc", 1), (3, "x" * 500, 1)] + [(7, f"text {i}", 1) for i in range(200)] + [(8, "same", 1)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, bytes int")
    got = X.shards(df, 100)
    assert got.count() == len(rows)
    by = {(r.shard, r.page): r for r in got.collect()}
    assert all(r.fits or r.id in (3, 8) for r in by.values())
    assert len({p for (s, p), r in by.items() if r.id == 7}) >= 13
    assert got.where("id = 8").select("page").distinct().count() == 1
    assert got.agg(F.sum("bytes")).first()[0] == sum(len(t or "") for _, t, _ in rows)
    assert X.shards(df.limit(0)).count() == 0


def test_pages_of_equal_ids_fit(spark):
    """Larger documents of one id, or of none, are split until each page fits; one over the limit is alone."""
    rows = [(i, f"{k} {i}".ljust(20 + 5 * (k % 9), "x")) for i in (7, None) for k in range(120)] + [(7, "y" * 300), (None, "z" * 101)]
    df = spark.createDataFrame(rows + [(9, "same text" * 4)] * 6, "doc_id long, text string")
    got = X.shards(df, 100).collect()
    assert len(got) == len(rows) + 6
    pages = defaultdict(list)
    for r in got:
        pages[r.shard, r.page].append(r)
    for p in pages.values():
        total = sum(r.bytes for r in p)
        assert all((r.shard_bytes, r.shard_docs, r.fits) == (total, len(p), total <= 100) for r in p)
        assert total <= 100 or len(p) == 1 or {r.id for r in p} == {9}
    assert sorted(r.bytes for r in got if not r.fits and r.id != 9) == [101, 300]
    assert sum(r.shard_docs for r in X.directory(X.shards(df, 100)).collect()) == len(got)
