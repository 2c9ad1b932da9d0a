"""Golden edge rows for lists, reports and feeds."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import filters as B
from millrace.operators import lists as C
from millrace.operators import reports as R

TS = dt.datetime(2024, 1, 5, 8, 0, 0)


def _orders(spark, rows):
    return spark.createDataFrame(rows, "id long, customer_id long, status string, total_amount double, "
                                       "paid_amount double, order_date date, created_at timestamp_ntz, "
                                       "order_number string")


def test_sales_last_days_zero_fills(spark):
    o = _orders(spark, [(1, 1, "paid", 10.0, 10.0, dt.date(2024, 1, 5), TS, "SO1"),
                        (2, 1, "cancelled", 99.0, 0.0, dt.date(2024, 1, 5), TS, "SO2"),
                        (3, 1, "pending", 5.0, 0.0, dt.date(2024, 1, 8), TS, "SO3")])   # a future day is ignored
    got = {r["date"]: r["total"] for r in R.sales_last_days(spark, o, "2024-01-06", 3).collect()}
    assert got == {dt.date(2024, 1, 4): 0.0, dt.date(2024, 1, 5): 10.0, dt.date(2024, 1, 6): 0.0}


def test_kanban_keeps_empty_lanes(spark):
    po = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "completed")], "id long, status string")
    got = {r["status"]: r["count"] for r in R.production_kanban(spark, po).collect()}
    assert got == {"pending": 2, "in_progress": 0, "completed": 1, "cancelled": 0}


def test_equipment_without_logs_counts_zero(spark):
    e = spark.createDataFrame([(1, "EQ1", "a"), (2, "EQ2", "b")], "id long, code string, name string")
    ml = spark.createDataFrame([(10, 1, dt.date(2024, 1, 1), "repair", 5.0, None),
                                (11, 1, dt.date(2024, 1, 3), "preventive", 1.0, None),
                                (12, 1, dt.date(2024, 1, 3), "repair", 2.0, None)],
                               "id long, equipment_id long, performed_date date, maintenance_type string, cost double, "
                               "next_due date")
    got = {r["id"]: (r["maintenance_count"], r["last_log"]["log_id"] if r["last_log"] else None)
           for r in C.equipment_status(e, ml).collect()}
    assert got == {1: (3, 12), 2: (0, None)}   # latest date, ties -> highest id


def test_empty_search_text_returns_nothing(spark):
    c = spark.createDataFrame([(1, "C1", "Ann", None, "retail", 1)],
                              "id long, code string, name string, phone string, type string, active int")
    p = spark.createDataFrame([(1, "P1", "Water", 5, "x", 1.0, 1)],
                              "id long, code string, name string, stock long, unit string, price double, active int")
    o = _orders(spark, [(1, 1, "paid", 10.0, 10.0, dt.date(2024, 1, 5), TS, "SO1")])
    assert B.global_search(c, p, o, "   ").count() == 0
    assert B.global_search(c, p, o, "an").where(F.col("grp") == "customers").count() == 1


def test_orders_awaiting_delivery(spark):
    o = _orders(spark, [(1, 1, "pending", 1.0, 0.0, None, TS, "a"), (2, 1, "confirmed", 1.0, 0.0, None, TS, "b"),
                        (3, 1, "paid", 1.0, 1.0, None, TS, "c"), (4, 1, "pending", 1.0, 0.0, None, TS, "d")])
    d = spark.createDataFrame([(4,)], "order_id long")
    assert sorted(r["id"] for r in C.orders_awaiting_delivery(o, d).collect()) == [1, 2]
