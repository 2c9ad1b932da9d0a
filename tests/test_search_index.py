"""Searches by the trigram index equal the scans, and a change builds its own blocks again."""

import pytest

from millrace.operators import filters as B
from millrace.operators.search_index import BLOCK, TrigramIndex, indexed_contains, indexed_search

WORDS = ["Spring Water", "spring", "SPR", "น้ำดื่ม ขวด", "Straße", "ΟΔΟΣ", "İzmir", "a%b_c", "100% pure", "", None, "ab", "abc", "aabcabc", "x\\y zz"]
ASKED = ["spr", "SPRING w", "ขวด", "น้ำ", "straße", "οδος", "i", "%", "_", "abc", "a%b", "sp%ter", "s_r", "100%", "x\\y", "zzz", "ab", "aabcabc", "İzm"]


def customers(spark):
    data = [(i * 700, f"C{i:05d}", WORDS[i % len(WORDS)], f"08{i}" if i % 3 else None, "retail" if i % 2 else "shop", 1 if i % 5 else 0) for i in range(60)]
    return spark.createDataFrame(data, "id long, code string, name string, phone string, type string, active int")


def test_searches_equal_scans(spark, tmp_path):
    c = customers(spark).cache()
    p = spark.createDataFrame([(i, f"P{i}", WORDS[i % len(WORDS)], 1, "u", 1.0, 1) for i in range(30)],
                              "id long, code string, name string, stock int, unit string, price double, active int").cache()
    o = spark.createDataFrame([(i, f"SO-{i:05d}", (i % 70) * 700, 1.0, "paid", "2000-01-01", i % 4) for i in range(120)],
                              "id long, order_number string, customer_id long, total_amount double, status string, order_date string, created_at int").cache()
    made = {}
    for name, df, cols, fold in (("c", c, ["name", "code", "phone"], "like"), ("p", p, ["name", "code"], "like"), ("o", o, ["order_number"], "like"),
                                 ("l", c, ["name", "code", "phone"], "lower")):
        made[name] = TrigramIndex(spark, str(tmp_path / name), cols, fold, buckets=2)
        made[name].build(0, df)
    ids = lambda df: sorted(r.id for r in df.collect())
    for q in ASKED:
        assert ids(indexed_contains(c, made["l"], ["name", "code", "phone"], q)) == ids(B.contains_filter(c, ["name", "code", "phone"], q)), q
    rows = lambda df: sorted(map(str, df.collect()))
    for q in ("spr", "so-0001", "%ring", "sp%ter", "c0000", "a_b", "  "):
        assert rows(indexed_search(c, p, o, made["c"], made["p"], made["o"], q)) == rows(B.global_search(c, p, o, q)), q
    with pytest.raises(ValueError):
        indexed_contains(c, made["c"], ["name"], "abc")


def test_a_change_builds_its_blocks_again(spark, tmp_path):
    c = customers(spark)
    index = TrigramIndex(spark, str(tmp_path / "i"), ["name"], "lower", buckets=8)
    index.build(0, c)
    new = spark.createDataFrame([(700, "C1", "renamed", None, "shop", 1), (5 * BLOCK + 1, "C9", "renamed too", None, "shop", 1)], c.schema)
    after = c.where("id <> 700").unionByName(new)
    held = index.stored.current()
    assert index.rebuild(1, new, after) and not index.rebuild(1, new, after)
    assert 1 <= sum(n == 1 for n in index.stored.current().values()) <= 2 < len(held)
    want = TrigramIndex(spark, str(tmp_path / "w"), ["name"], "lower", buckets=8)
    want.build(0, after)
    rows = lambda i: sorted(map(str, i.stored.read().select("block", "gram", "ids").collect()))
    assert rows(index) == rows(want)
    assert sorted(r.id for r in index.candidates("renamed").collect()) == [700, 5 * BLOCK + 1]


def test_empty_table(spark, tmp_path):
    c = customers(spark).where("false")
    index = TrigramIndex(spark, str(tmp_path / "i"), ["name"], "lower", buckets=2)
    index.build(0, c)
    assert indexed_contains(c, index, ["name"], "abc").count() == 0
