"""Merkle manifests against a plain tree and DuckDB."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle as M
from tests.duck_oracle import compare, duck


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(hs):
    out = [hs]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def steps(tree, i):
    for level in tree[:-1]:
        a = i - i % 3
        yield "".join(level[a:i]), "".join(level[i + 1:a + 3])
        i //= 3


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> results of the query, sorted."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((sha("".join(map(part, r))), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([h for h, _ in sorted(by[s], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))]) for s in by}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for s in order:
        for i, (h, r) in enumerate(sorted(by[s], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            path = [*steps(trees[s], i), *steps(top, order.index(s))]
            x = sha("".join(map(part, (*r[:4], text))))
            for left, right in path:
                x = sha(left + x + right)
            out.append((r[0], h, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), x, x == top[-1][0]))
    return sorted(out, key=str)


def query(spark, tmp_path, rows, schema="doc_id long, source string, lang string, n_chars long, text string, g int, h int, kids int, `load` int, rank int"):
    spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in M.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, tmp_path, n):
    rows = [(i, "a", "en", i, f"x\n{i}") for i in range(n)]
    assert query(spark, tmp_path, rows) == plain(rows)


def test_tiers_and_edge_rows(spark, tmp_path, monkeypatch):
    """Blocks of nine leaves: three tiers; NULLs, empty and long texts, repeated rows and ids, a hot source."""
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 9)
    rnd = random.Random(3)
    rows = [(i, "hot", "en", i, f"text {i}\nend") for i in range(200)]
    rows += [(i, f"s{rnd.randrange(30)}", None, None, "é\n" * rnd.randrange(4)) for i in range(200, 320)]
    rows += [(None, "hot", None, 3, "a\nb"), (None, None, None, None, None), (None, None, "", 0, ""), (7, "hot", "en", 7, "text 7\nend"),
             (7, "hot", "en", 7, "other"), (7, "", "en", 7, "other"), (1000, "é", "x", -1, "w\n" * 300_000), (1001, "z", "=", 1, "-")]
    rows += [(5000, "copies", "en", 1, "same\n")] * 60
    rnd.shuffle(rows)
    assert query(spark, tmp_path, rows) == plain(rows)


def test_empty_table_and_string_ids(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id string, source string, lang string, n_chars int, text string")
    assert M.manifest(df).count() == 0
    rows = [("b", "s", None, 1, "x"), ("a", "s", None, 1, "y"), ("a", "t", None, 1, "y")]
    got = M.manifest(spark.createDataFrame(rows, df.schema), carry={"kept": F.col("text")}).collect()
    assert {(r.id, r.kept, r.leaf) for r in got} == {(r[0], r[4], sha("".join(map(part, r)))) for r in rows}
    assert len({r.root for r in got}) == 1


def test_no_leaf_is_shuffled_more_than_twice(spark, sf_dir):
    """Ranges and blocks; the groupings within a block use the blocks' exchange."""
    rows = spark.createDataFrame([], "g string, rank long, size long, h string, load struct<id:long>")
    plan = M._blocks(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_query_equals_duckdb(spark, sf_dir):
    assert compare(M.op12_merkle_manifest(spark, sf_dir), duck(sf_dir), M.ORACLE) is None
