"""Stored tables: batches equal the changes in one go, touch their own partitions only, and replay as no-ops."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import rules as I
from millrace.operators.stored import store_changes, store_settings
from millrace.sources.stored import StoredTable

PRODUCTS = "id long, code string, name string, price double, active int"
CHANGES = "seq long, op string, code string, name string, price double"
EXPENSES = "id long, category string, amount double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(table.path) for f in fs}


@pytest.mark.parametrize("entity", ["products", "materials"])
def test_batches_equal_one_application(spark, tmp_path, entity):
    rnd = random.Random(7)
    spec = "products" if entity == "products" else dict(I.CHANGE_SPECS["raw_materials"])  # soft and hard deletes
    start = spark.createDataFrame([(i, f"c{i}", f"n{i}", float(i), 1) for i in range(1, 31)], PRODUCTS)
    feed = [(n, rnd.choice(["insert", "update", "update", "delete", "other", None]), rnd.choice([f"c{rnd.randrange(1, 45)}", "c1", None]),
             rnd.choice(["x", "y", None]), rnd.choice([1.5, None])) for n in range(120)]
    table = StoredTable(spark, str(tmp_path / "t"), ["code"], 8)
    table.load(0, start)
    want, refused = start, []
    for n in range(3):
        part = spark.createDataFrame(feed[n * 40:(n + 1) * 40], CHANGES)
        assert store_changes(table, n + 1, part, spec, rejects_to=str(tmp_path / "no"))
        want, no = I.apply_changes(want, part, spec)
        refused += rows(no)
        want = spark.createDataFrame(want.collect(), PRODUCTS)
        assert rows(table.read()) == rows(want)
    assert rows(spark.read.parquet(str(tmp_path / "no")).drop("batch")) == sorted(refused, key=repr)


def test_new_ids_keep_the_rows_beside_them(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["id"], 4)
    start = spark.createDataFrame([(i, "a", 1.0) for i in range(1, 21)], EXPENSES)
    table.load(0, start)
    ch = spark.createDataFrame([(1, "insert", None, "b", 2.0), (2, "update", 21, "c", 3.0), (3, "delete", 5, None, None),
                                (4, "insert", None, "d", 4.0), (5, "update", 99, "e", 5.0)], "seq long, op string, id long, category string, amount double")
    store_changes(table, 1, ch, "expenses")
    assert rows(table.read()) == rows(I.apply_changes(start, ch, "expenses")[0])
    assert table.read().count() == 21


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["code"], 16)
    table.load(0, spark.createDataFrame([(i, f"c{i}", "n", 1.0, 1) for i in range(200)], PRODUCTS))
    before, held = files(table), table.current()
    store_changes(table, 1, spark.createDataFrame([(1, "update", "c7", "new", 2.0), (2, "delete", "c8", None, None)], CHANGES))
    assert {f: t for f, t in files(table).items() if f in before} == before
    moved = [b for b, n in table.current().items() if n != held[b]]
    assert 1 <= len(moved) <= 2
    assert table.vacuum() == len(moved)
    left = files(table)
    assert all(f in left for f in before if not any(f"_bucket={b}/" in f for b in moved) and "_bucket=" in f)
    assert table.read().where("name = 'new'").count() == 1 and table.read().count() == 200


def test_a_replay_does_nothing_and_a_broken_batch_is_not_seen(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["code"], 4)
    table.load(0, spark.createDataFrame([(1, "a", "n", 1.0, 1)], PRODUCTS))
    ins = spark.createDataFrame([(1, "insert", "b", "m", 2.0)], CHANGES)
    assert store_changes(table, 1, ins)
    once, stamp = rows(table.read()), files(table)
    assert not store_changes(table, 1, ins) and not table.load(0, ins.select("code"))
    assert rows(table.read()) == once and files(table) == stamp
    # a batch that fails half way leaves the table as it was, and runs again
    bad = lambda df: df.withColumn("price", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        table.merge(2, ins.select("code"), bad)
    os.makedirs(f"{table.path}/batch=2/_bucket=0", exist_ok=True)
    assert table.batches() == [0, 1] and rows(table.read()) == once
    assert store_changes(table, 2, spark.createDataFrame([(1, "update", "b", "k", 3.0)], CHANGES))
    assert table.read().where("code = 'b'").first().name == "k"


def test_a_bucket_may_become_empty_and_strays_are_refused(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["code"], 4)
    start = spark.createDataFrame([(1, "a", "n", 1.0, 1), (2, None, "null key", 1.0, 1)], PRODUCTS)
    table.load(0, start)
    table.merge(1, start.select("code"), lambda df: df.where("false"))
    assert table.read().count() == 0 and table.read().columns == start.columns
    with pytest.raises(Exception, match="outside the touched"):
        table.merge(2, start.where("code = 'a'"), lambda df: spark.range(50).selectExpr("id", "concat('k', id) AS code"))
    with pytest.raises(ValueError, match="taken"):
        table.load(3, start.withColumn("_row", F.lit(1)))
    with pytest.raises(ValueError, match="stored by"):
        store_changes(table, 4, start, "expenses")


def test_settings(spark, tmp_path):
    log = spark.createDataFrame([(i, f"k{i % 7}" if i % 11 else None, f"v{i}", i) for i in range(60)], "seq long, key string, value string, updated_at long")
    table = StoredTable(spark, str(tmp_path / "t"), ["key"], 8)
    table.load(0, I.settings_upsert(None, log.where("seq < 20 AND key IS NOT NULL")))
    for n, (a, b) in enumerate(((20, 40), (40, 60))):
        store_settings(table, n + 1, log.where(f"seq >= {a} AND seq < {b} AND key IS NOT NULL"))
    assert rows(table.read()) == rows(I.settings_upsert(None, log.where("key IS NOT NULL")))
