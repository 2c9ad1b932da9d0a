"""Refreshed views equal full recomputes, and read the changes only."""

import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.operators import refresh as V
from millrace.operators import reports as R

SCHEMA = "id long, customer_id long, order_date date, status string, total_amount double, paid_amount double"


def made(rnd, i):
    return (i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([dt.date(2000, 1, rnd.randrange(1, 32)), dt.date(1999, 12, 31), None]),
            rnd.choice(["pending", "confirmed", "delivered", "paid", "cancelled", None]), rnd.choice([10.0, 0.1, 99.99, None]), rnd.choice([0.0, 5.05, 10.0]))


def test_views_equal_recomputes_over_many_changes(spark, tmp_path):
    rnd = random.Random(3)
    stored = {i: made(rnd, i) for i in range(300)}
    frame = lambda rows: spark.createDataFrame(list(rows), SCHEMA)
    sales, owed = V.sales_view(frame(stored.values())), V.outstanding_view(frame(stored.values()))
    for n in range(3):
        old, new = [], []
        for i in rnd.sample(range(330), 40):            # changed, deleted and new orders
            if i in stored:
                old.append(stored.pop(i))
            if rnd.random() < 0.7:
                stored[i] = made(rnd, i)
                new.append(stored[i])
        sales = V.refreshed(sales, frame(old), frame(new), V.sales_view, ("order_date",))
        owed = V.refreshed(owed, frame(old), frame(new), V.outstanding_view, ("customer_id",))
        sales.write.parquet(f"{tmp_path}/s{n}")
        owed.write.parquet(f"{tmp_path}/o{n}")
        sales, owed = spark.read.parquet(f"{tmp_path}/s{n}"), spark.read.parquet(f"{tmp_path}/o{n}")
    o = frame(stored.values())
    c = spark.createDataFrame([(1, "a", "n", "p", 1.0, 0.0, 1), (2, "b", "n", "p", 1.0, 0.0, 0), (3, "c", "n", "p", 1.0, 0.0, 1), (4, "d", "n", "p", 1.0, 0.0, 1)],
                              "id long, code string, name string, phone string, credit_limit double, balance double, active int")
    p = spark.createDataFrame([(1, 5, 9, 1), (2, 5, 9, 0), (3, 20, 9, 1)], "id long, stock int, min_stock int, active int")
    m = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 2.0)], "id long, quantity double, min_quantity double")
    po = spark.createDataFrame([(1, "pending"), (2, "completed")], "id long, status string")
    for as_of in ("2000-01-10", "2000-01-31", "1999-12-31"):
        want = R.dashboard_kpis(o, c, p, po, m, as_of).first().asDict()
        got = V.dashboard(sales, V.customers_view(c), V.products_view(p), V.production_view(po), V.materials_view(m), as_of).first().asDict()
        assert got == want
    both = lambda df: {r.customer_id: r.outstanding or 0.0 for r in df.collect()}
    assert both(V.outstanding(owed)) == both(R.customer_outstanding(o))
    assert [tuple(r) for r in V.receivables(c, owed).collect()] == [tuple(r) for r in R.receivables_by_customer(c, o).collect()]


def test_a_refresh_reads_no_base_table(spark, tmp_path):
    rnd = random.Random(5)
    spark.createDataFrame([made(rnd, i) for i in range(50)], SCHEMA).write.parquet(f"{tmp_path}/base")
    V.sales_view(spark.read.parquet(f"{tmp_path}/base")).write.parquet(f"{tmp_path}/view")
    changes = spark.createDataFrame([made(rnd, 1)], SCHEMA)
    out = V.refreshed(spark.read.parquet(f"{tmp_path}/view"), changes, changes.withColumn("status", F.lit("paid")), V.sales_view, ("order_date",))
    assert [f.rsplit("/", 2)[1] for f in out.inputFiles()] and all("/view/" in f for f in out.inputFiles())


def test_empty_tables(spark):
    o = spark.createDataFrame([], SCHEMA)
    assert V.refreshed(V.sales_view(o), o, o, V.sales_view, ("order_date",)).count() == 0
