"""Column helpers and sinks on hand-made edge rows."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from millrace.functions import scalars as H
from millrace.operators import filters as B
from millrace.operators import reports as R
from millrace.operators.rules import js_number
from millrace.sources import io as A


def test_sqlite_like_semantics(spark):
    df = spark.createDataFrame([("ABC_x",), ("abcZx",), ("a%b",), ("aXb",), ("c\\d",), ("Éclair",), ("éclair",)], "s string")

    def hits(q):
        return sorted(r["s"] for r in df.where(H.sqlite_like_contains("s", q)).collect())
    assert hits("abc_") == ["ABC_x", "abcZx"]          # _ is a wildcard, ASCII case folding
    assert hits("a%b") == ["ABC_x", "a%b", "aXb", "abcZx"]   # % is a wildcard: a ... b
    assert hits("c\\d") == ["c\\d"]                    # backslash is literal (no escape char)
    assert hits("écl") == ["éclair"]                   # no folding beyond ASCII


def test_js_contains_unicode_lower(spark):
    df = spark.createDataFrame([("Éclair", None), ("x", "0812")], "name string, phone string")
    assert B.contains_filter(df, ["name", "phone"], "écl").count() == 1
    assert B.contains_filter(df, ["name", "phone"], "081").count() == 1


def test_stock_edges(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, -5, 10), (3, 10, 10), (4, 3, 0), (5, 11, 10)],
                               "id long, stock long, min_stock long")
    st = {r["id"]: (r["s"], r["p"]) for r in df.select("id", H.stock_status("stock", "min_stock").alias("s"),
                                                       H.stock_pct("stock", "min_stock").alias("p")).collect()}
    assert st == {1: ("empty", 0), 2: ("ok", -25), 3: ("low", 50), 4: ("ok", 100), 5: ("ok", 55)}
    c = R.stock_level_counts(df).collect()[0]
    assert (c["total"], c["ok"], c["low"], c["out"]) == (5, 2, 1, 1)   # negative stock is in no bucket


def test_size_label_and_numbers(spark):
    df = spark.createDataFrame([(None,), (0,), (350,), (1500,), (19000,)], "ml int")
    assert [r[0] for r in df.select(H.size_label("ml")).collect()] == ["-", "-", "350ml", "1.5L", "19L"]
    n = spark.createDataFrame([(100.0,), (6.55,), (12345678.5,)], "x double")
    assert [r[0] for r in n.select(js_number(F.col("x"))).collect()] == ["100", "6.55", "12345678.5"]


def test_labels_fallbacks_and_dates(spark):
    df = spark.createDataFrame([("cash", "paid", dt.date(2024, 1, 5)), ("credit", "weird", None)],
                               "m string, s string, d date")
    r = df.select(H.label("payment_method", "m").alias("m"), H.label("status", "s").alias("s"),
                  H.fmt_date("d").alias("d")).collect()
    assert r[0]["m"] == "เงินสด" and r[1]["m"] == H.PAYMENT_METHOD_FALLBACK
    assert r[0]["s"] == "ชำระแล้ว" and r[1]["s"] == "weird"
    assert r[0]["d"] == "5 ม.ค. 2567" and r[1]["d"] == "-"


def test_strip_first_prefix_only_once(spark):
    df = spark.createDataFrame([("น้ำดื่ม น้ำดื่ม 600ml",)], "n string")
    assert df.select(H.strip_first("n", ["น้ำดื่ม "])).first()[0] == "น้ำดื่ม 600ml"


def test_csv_export_quoting_and_bom(spark):
    df = spark.createDataFrame([("b", 'say "hi"', "x,y"), ("a", "line\nbreak", "ไทย")], "k string, c1 string, c2 string")
    out = os.path.join(tempfile.mkdtemp(prefix="csv-", dir="/tmp"), "r")
    assert A.export_csv(df, out, [F.col("c1"), F.col("c2")], ["หัว 1", 'h"2'], [("k", True)])
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    text = "".join(open(os.path.join(out, p), encoding="utf-8").read() for p in parts)
    assert text == '﻿"หัว 1","h""2"\n"line\nbreak","ไทย"\n"say ""hi""","x,y"\n'
    assert not A.export_csv(df.limit(0), out + "2", [F.col("c1")], ["h"], [("k", True)])


def test_normalize_input_empty_strings_and_numbers(spark):
    from pyspark.sql import types as T
    raw = spark.createDataFrame([(" 5 ", "", "abc", " 2024-01-02 ")], "a string, b string, c string, d string")
    sch = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()),
                        T.StructField("c", T.DoubleType()), T.StructField("d", T.DateType())])
    r = A.normalize_input(raw, sch).collect()[0]
    assert (r["a"], r["b"], r["c"], r["d"]) == (5, None, 0.0, dt.date(2024, 1, 2))


def test_maintenance_due_rules(spark):
    e = spark.createDataFrame([(1, "active", dt.date(2024, 1, 22)), (2, "inactive", dt.date(2024, 1, 21)),
                               (3, "active", None), (4, "active", dt.date(2024, 2, 1))],
                              "id long, status string, next_maintenance date")
    assert [r["id"] for r in B.maintenance_due(e, "2024-01-20", 7, True).collect()] == [1]
    assert sorted(r["id"] for r in B.maintenance_due(e, "2024-01-20", 7, False).collect()) == [1, 2]


def test_material_kind_golden(spark):
    """Keywords in Thai names, the first in the list of kinds wins."""
    rows = {"ขวดเปล่า 600ml": "bottle", "ฝาเกลียว": "cap", "ฉลากขวด": "bottle", "ฉลากสินค้า": "label", "ถัง 19L": "tank", "สารกรองน้ำ": "filter",
            "ไส้กรอง": "filter", "ผงคาร์บอน": "carbon", "ซีลฝา": "cap", "ซีลหด": "seal", "กล่อง": "box", "": "box", None: "box"}
    df = spark.createDataFrame(list(rows.items()), "n string, want string")
    assert df.where(H.material_kind("n") != F.col("want")).count() == 0


def test_labels_golden(spark):
    want = [("status", "in_transit", "กำลังส่ง"), ("customer_type", "wholesale", "ขายส่ง"), ("role", "manager", "ผู้จัดการ"),
            ("po_status", "ordered", "สั่งแล้ว"), ("expense_category", "fuel", "ค่าเชื้อเพลิง"), ("return_reason", "wrong_order", "สั่งผิด"),
            ("return_status", "rejected", "ปฏิเสธ"), ("route_status", "in_progress", "กำลังจัดส่ง"), ("material_move", "in", "รับเข้า"),
            ("material_move", "waste", "เบิกออก"), ("payment_method", "check", "เช็ค"), ("payment_method", "credit", "เครดิต"),
            ("status", "unheard_of", "unheard_of"), ("status", None, None)]
    df = spark.createDataFrame([(i, c) for i, (_, c, _) in enumerate(want)], "i int, code string")
    for i, (domain, _, label) in enumerate(want):
        assert df.where(F.col("i") == i).select(H.label(domain, "code")).first()[0] == label


def test_brand_prefix_golden(spark):
    df = spark.createDataFrame([("น้ำดื่ม 600ml",), ("น้ำดื่มแก้ว",), ("ถัง น้ำดื่ม 19L",), (None,)], "n string")
    assert [r[0] for r in df.select(H.strip_first("n", H.BRAND_PREFIXES)).collect()] == ["600ml", "น้ำดื่มแก้ว", "ถัง 19L", None]
