"""Weighted fair queueing: against its SQL, and the rules of the mix."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from millrace.llm import fair_mix as M
from duck_oracle import compare, duck


@pytest.mark.parametrize("name", ["op4_fair_mix", "op5_phrase_decontamination", "op9_extendible_shards"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_equal_their_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    assert compare(E.queries()[name](spark, d), duck(d), E.oracle_sql()[name]) is None


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
    total, target = sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    free, left = set(sizes), float(total)
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > cap * sizes[s]}
        if not full:
            target.update({s: level * w[s] for s in free})
            break
        for s in full:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in full)
        free -= full
    return target


@pytest.mark.parametrize("blocks", [M.ROWS_PER_BLOCK, 5])
def test_rules(spark, monkeypatch, blocks):
    monkeypatch.setattr(M, "ROWS_PER_BLOCK", blocks)
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 30)), rnd.choice(["a", "b", "b", "b", "b", "c", "é", None])) for i in range(400)]
    rows += [(1000 + i, None, "a") for i in range(5)] + [(2000, "tiny", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix", F.lit(1))
    out = M.mix(df)
    assert out.columns[:4] == df.columns
    got = out.select("doc_id", "source", F.col(out.columns[-1] + ".*")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[M_key(s)] = sizes.get(M_key(s), 0) + len((t or "").split())
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[M_key(r.source)]) and r.source_size == sizes[M_key(r.source)]
        assert 0 <= r.copies <= 3 and (r.size or not r.copies)
        taken[M_key(r.source)] += r.size * r.copies
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    again = {(r.doc_id, r[-1]["copies"]) for r in M.mix(df.repartition(7)).select("doc_id", out.columns[-1]).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    queue, _ = M.queue(df)
    assert sorted((r.flow, r.place) for r in queue.where("copy = 1").collect()) == sorted(
        {(r.flow, r.place) for r in queue.collect()})
    mixed = M.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def M_key(source):
    return "1" if source is None else "0" + source


def test_edge_tables(spark):
    df = spark.createDataFrame([(1, None, None), (None, "a b", None), (None, "c", None), (2, "a", "s"), (2, "a", "s")],
                               "doc_id long, text string, source string")
    out = M.mix(df)
    got = sorted(((r.doc_id, r.size, r.source_size) for r in out.select("doc_id", out.columns[-1] + ".*").collect()), key=str)
    assert got == sorted([(1, 0, 3), (None, 2, 3), (None, 1, 3), (2, 1, 2), (2, 1, 2)], key=str)
    assert M.mix(df.limit(0)).count() == 0 and M.mixed(df.limit(0)).columns == df.columns
    assert M.mixed(df.where("doc_id = 1")).count() == 0


@pytest.mark.parametrize("blocks", [M.ROWS_PER_BLOCK, 5])
def test_rows_without_own_ids_are_taken_one_by_one(spark, monkeypatch, blocks):
    """Sources of NULL ids, of one id and of one repeated row come as near to their targets as others."""
    monkeypatch.setattr(M, "ROWS_PER_BLOCK", blocks)
    rnd = random.Random(2)
    text = lambda i: f"t{i} " + "w " * rnd.randrange(1, 20)
    rows = [(i, text(i), "a") for i in range(100)] + [(None, text(i), "b") for i in range(400)]
    rows += [(7, text(i), "c") for i in range(300)] + [(8, "the same three", "d")] * 500 + [(None, "one more text", None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes = {}
    for _, t, s in rows:
        sizes[M_key(s)] = sizes.get(M_key(s), 0) + len(t.split())
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    found = []
    for d in (df, df.repartition(3)):
        out = M.mix(d)
        found.append(sorted((M_key(r.source), str(r.doc_id), r.text, r[-1]["copies"]) for r in out.collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    for s, _, t, n in found[0]:
        taken[s] += n * len(t.split())
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes), (taken, want)
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(len({n for f, *_, n in found[0] if f == s}) <= 2 for s in sizes)
