"""Two-level running totals vs one-pass windows and plain Python folds."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans.scan import _blocked, block_cuts, carried, clamped_balance, prefix_sums, previous_value, running_count


def _frame(spark, n=400, keys=3, seed=7):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(keys), rnd.choice([-1, 1]) * round(rnd.uniform(0, 50), 2), rnd.random() < 0.5)
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, k long, d double, c boolean"), rows


def test_prefix_sums_match_one_pass_window(spark):
    df, _ = _frame(spark)
    two = prefix_sums(df, ["k"], ["id"], {"s": F.col("d").cast("decimal(18,4)")})
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    one = df.withColumn("s1", F.sum(F.col("d").cast("decimal(18,4)")).over(w))
    j = two.join(one.select("id", "s1"), "id")
    assert j.where(F.col("s") != F.col("s1")).count() == 0


def test_running_count_exclusive_with_condition(spark):
    df, rows = _frame(spark)
    out = {r["id"]: r["n"] for r in running_count(df, ["k"], ["id"], "n",
                                                  where=F.col("c"), inclusive=False).collect()}
    seen = {}
    for i, k, _d, c in rows:
        assert out[i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + (1 if c else 0)


def test_clamped_balance_matches_sequential_fold(spark):
    df, rows = _frame(spark, n=600)
    df = df.withColumn("x0", F.lit(20.0))
    out = {r["id"]: r["balance"] for r in clamped_balance(df, ["k"], ["id"], F.col("d"),
                                                          F.col("c"), F.col("x0")).collect()}
    bal = {}
    for i, k, d, c in rows:
        b = bal.get(k, 20.0) + d
        b = max(0.0, b) if c else b
        bal[k] = round(b, 4)
        assert abs(out[i] - bal[k]) < 1e-6, (i, out[i], bal[k])


def test_previous_value_matches_lag(spark):
    df, rows = _frame(spark, n=300)
    out = {r["id"]: (r["p"], r["_is_first"]) for r in
           previous_value(df, ["k"], ["id"], "d", "p").collect()}
    last = {}
    for i, k, d, _c in rows:
        assert out[i] == (last.get(k), k not in last)
        last[k] = d


def test_rows_of_one_time_fall_into_many_blocks(spark):
    """A bulk load with one timestamp, and a hot key: blocks hold about equal numbers of rows."""
    df = spark.range(4000).select("id", (F.col("id") % 5 > 0).cast("long").alias("k"), F.lit(7).cast("long").alias("t"))
    rows = _blocked(df, ["k"], ["t", "id"], block_cuts(df, "t", "id", blocks=20)).groupBy("_blk").count().collect()
    assert len(rows) == 20 and max(r["count"] for r in rows) < 2.5 * 4000 / 20
    out = {r["id"]: r.n for r in running_count(df, ["k"], ["t", "id"], "n").collect()}
    seen = {}
    for i in range(4000):
        seen[i % 5 > 0] = seen.get(i % 5 > 0, 0) + 1
        assert out[i] == seen[i % 5 > 0]


def test_carried_equals_plain_loop(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(3), rnd.randrange(40), rnd.choice([None, None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, t long, v long")
    got = carried(df, ["k"], ["t", "id"], {"f": ("first", F.col("v")), "l": ("last", F.when(F.col("v") > 1, F.col("v")))}).collect()
    state, want = {}, {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        f, last = state.get(k, (None, None))
        want[i] = (f, last)
        state[k] = (v if f is None else f, v if v and v > 1 else last)
    assert {r["id"]: (r.f, r.l) for r in got} == want
