"""Bucketed order-keyed tables: same results, and the item/order join without a shuffle."""

import os
import re
import tempfile

import __spark_entry__ as E
from duck_oracle import canon
from millrace.sources.layout import write_colocated


def _exchanges_under_joins(plan: str) -> int:
    """Shuffles on the order key (named order_id / l_orderkey / o_orderkey in the plans)."""
    return len(re.findall(r"Exchange hashpartitioning\((order_id|l_orderkey|o_orderkey)#", plan))


def test_colocated_tables_give_same_results_without_order_key_shuffles(spark, sf_dir):
    db = "factory_" + os.path.basename(tempfile.mkdtemp(prefix="t", dir="/tmp"))
    src = write_colocated(spark, sf_dir, db, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force shuffle joins to see the difference
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ["d10_profit_by_product", "c3_sales_documents", "l4_reconcile_totals"]:
            files = E.queries()[name](spark, sf_dir)
            cat = E.queries()[name](spark, src)
            assert canon(files.columns, files.collect()) == canon(cat.columns, cat.collect())
        plan = E.queries()["d10_profit_by_product"](spark, src)._jdf.queryExecution().executedPlan().toString()
        assert _exchanges_under_joins(plan) == 0
        plain = E.queries()["d10_profit_by_product"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert _exchanges_under_joins(plain) > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
