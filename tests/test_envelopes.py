"""A5: every report written, read back as one JSON object and compared with its frames."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators.envelopes import REPORTS, report
from millrace.sources.bindings import Tables
from millrace.sources.io import Part, export_json
from millrace.sources.report_sink import write_report

SHAPES = {
    "sales": ["summary", "byDay", "byProduct", "byCustomer", "from", "to"], "inventory": ["products", "materials", "productValue", "materialValue"],
    "production": ["orders", "summary", "from", "to"], "profit": ["byProduct", "total", "from", "to"],
    "expenses": ["byCategory", "total", "byMonth", "from", "to"], "credit": ["customers", "aging"],
    "qc": ["tests", "summary", "avgValues", "from", "to"],
}


@pytest.mark.parametrize("name", REPORTS)
@pytest.mark.parametrize("period", [("1995-01-01", "2030-12-31"), ("1980-01-01", "1980-01-02")])
def test_report_file_is_one_object(spark, sf_dir, tmp_path, name, period):
    parts, meta = report(Tables(spark, sf_dir), name, *period, as_of_ts="2000-01-31 00:00:00")
    path = f"{tmp_path}/{name}"
    export_json(parts, meta, path)
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))
    got = json.loads(text)
    assert list(got) == SHAPES[name]
    assert {k: got[k] for k in meta} == meta
    for p in parts:
        rows = [r.asDict() for r in (p.rows.orderBy(*p.order) if p.order else p.rows).collect()]
        if p.kind == "array":
            assert [list(r) for r in got[p.name]] == [list(r) for r in rows]
            key = rows[0].keys() & {"id", "date", "product_id", "customer_id", "category", "month", "result"} if rows else []
            assert [[str(r[k]) for k in sorted(key)] for r in got[p.name]] == [[str(r[k]) for k in sorted(key)] for r in rows]
        elif p.kind == "object":
            assert got[p.name] == pytest.approx(rows[0])
        else:
            assert got[p.name] == pytest.approx(next(iter(rows[0].values())))


def read_back(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_equal_rows_and_many_tasks(spark, tmp_path):
    """Commas go by position: rows that repeat, arrays over many tasks, empty and one-row arrays."""
    many = spark.range(3000).select((F.col("id") / 10).cast("int").alias("k"))
    few = spark.createDataFrame([("p", 1), ("p", 1), ("q", 2)], "name string, n int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts = [Part("a", "array", few, (F.col("name"),)), Part("none", "array", few.limit(0)), Part("many", "array", many, (F.col("k"),)),
             Part("one", "array", few.limit(1)), Part("value", "value", few.agg(F.sum("n").alias("s")))]
    export_json(parts, {"from": "x"}, f"{tmp_path}/r")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = json.loads(read_back(f"{tmp_path}/r"))
    assert got["a"] == [{"name": "p", "n": 1}, {"name": "p", "n": 1}, {"name": "q", "n": 2}]
    assert [r["k"] for r in got["many"]] == sorted(i // 10 for i in range(3000))
    assert (got["none"], got["one"], got["value"], got["from"]) == ([], [{"name": "p", "n": 1}], 4, "x")
    assert len(glob.glob(f"{tmp_path}/r/part-*-2")) > 3 and not glob.glob(f"{tmp_path}/r/_write-*")
    export_json(parts[:1], {}, f"{tmp_path}/r")
    assert list(json.loads(read_back(f"{tmp_path}/r"))) == ["a"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(100).select(F.when(F.col("id") < 90, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("broken"))).alias("line"), F.lit(False).alias("item"))
    with pytest.raises(Exception, match="broken"):
        write_report(bad.orderBy("line"), f"{tmp_path}/x")
    assert not glob.glob(f"{tmp_path}/x/*")
