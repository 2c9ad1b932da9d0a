"""SimHash linking against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash as S
from millrace.llm.common import read_table


def brute_components(fps):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= S.MAX_BITS_APART:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {f: root(f) for f in fps}


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > n)


def test_fingerprint_by_definition():
    for t in ("", "  \n", "One", "a B", "a b c", "A b  c\td e e e", "é É ñ x y z " * 50):
        assert S.text_fingerprint(t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("pairwise", [64, 4, 1])
def test_components_equal_brute_force_for_any_bucket_size(spark, pairwise):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for _ in range(rnd.randrange(8)):
            f ^= sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 5)))
            fps.append(f)
    fps = sorted({S._signed(f) for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.label for r in S.components(S.links(df, pairwise)).collect()}
    want = brute_components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
    assert {f: got.get(f, f) for f in fps} == {f: min(groups[want[f]]) for f in fps}


def test_query_equals_brute_force(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    fps = {r.doc_id: S._signed(plain_fingerprint(r.text or "")) for r in docs}
    root = brute_components(fps.values())
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    got = S.op8_simhash_dedup(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {
        i: (f & ((1 << 64) - 1), least[root[f]]) for i, f in fps.items()}


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two three four", "y"), (3, "one two three four", "y"),
            (None, "one two three four", "z"), (None, "quite other words in here", "z"), (None, "quite other words in here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnsRenamed({})
    got = sorted(((r.id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (None, None), (None, None)], key=str)
    kept = S.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, None), (3, "one two three four"), (None, "quite other words in here")], key=str)
    empty = df.limit(0)
    assert S.near_duplicates(empty).count() == 0 and S.deduplicate(empty).count() == 0


def test_equal_ids_with_different_texts(spark):
    """A text stays or goes for its own group, whatever other rows its id has."""
    a, b, c = "one two three four", "quite other words in here", "a third text of its own"
    for rows, want in (
            ([(5, a), (5, b), (3, b)], [(3, b), (5, a)]),                # only (5, b) has a smaller id beside it
            ([(5, a), (5, b)], [(5, a), (5, b)]),                        # two groups of the same least id
            ([(5, a), (5, b), (5, b), (7, a), (3, c), (5, c), (None, a)], [(3, c), (5, a), (5, b)])):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
        out = S.deduplicate(df)
        assert out.columns == df.columns
        assert sorted((r.doc_id, r.text) for r in out.collect()) == want


def test_one_text_of_a_group_whose_least_id_repeats(spark):
    """Two near texts of one id are one group, of which one row stays."""
    pairs = ((" ".join(f"w{i}" for i in range(n)), " ".join(f"w{i}" for i in range(n + 1))) for n in range(300, 400))
    text, near = next((x, y) for x, y in pairs if 1 <= (
        S.text_fingerprint(x.encode()) ^ S.text_fingerprint(y.encode())).bit_count() <= S.MAX_BITS_APART)
    df = spark.createDataFrame([(5, text), (5, near), (6, near)], "doc_id long, text string")
    assert [r.doc_id for r in S.deduplicate(df).collect()] == [5]
