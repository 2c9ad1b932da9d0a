"""Bindings see all data: rows added later, keys beyond any fixed range."""

from pyspark.sql import functions as F

from millrace.sources.bindings import BINDINGS, Tables


def test_new_tables_object_sees_appended_files(spark, tmp_path):
    base = Tables(spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    path = f"{tmp_path}/orders.parquet"
    orders.write.parquet(path)
    assert Tables(spark, str(tmp_path)).sales_orders.count() == base.sales_orders.count()
    orders.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000).write.mode("append").parquet(path)
    assert Tables(spark, str(tmp_path)).sales_orders.count() == 2 * base.sales_orders.count()


def test_no_id_arithmetic_in_row_filters():
    for name, b in BINDINGS.items():
        where = (b.where or "") + (b.oracle or "").rpartition(" WHERE ")[2] * (" WHERE " in (b.oracle or ""))
        assert "%" not in where and "key <" not in where, name


def test_every_part_is_a_material_and_every_line_a_purchase(spark, sf_dir):
    t = Tables(spark, sf_dir)
    n = lambda x: spark.read.parquet(f"{sf_dir}/{x}.parquet").count()
    assert t.raw_materials.count() == n("part")
    assert t.purchase_items.count() == n("lineitem") and t.purchase_orders.count() == n("orders")
