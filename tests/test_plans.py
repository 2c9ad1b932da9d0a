"""Plans as on tables too large to broadcast: initial physical plans with broadcasting off."""

import re

import pytest

import __spark_entry__ as E

BIG = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def plan(spark, sf_dir):
    was = spark.conf.get(BIG)
    spark.conf.set(BIG, "-1")
    yield lambda name: E.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(BIG, was)


def test_foreign_keys_need_one_exchange_and_few_scans(plan):
    p = plan("l1_fk_orphans")
    assert "LeftAnti" not in p and p.count("FileScan parquet") <= 14
    assert len(re.findall(r"Exchange hashpartitioning\(parent", p)) == 2      # by (parent, key), and of their counts


@pytest.mark.parametrize("name", ["c1_sales_list", "c7_qc_list", "c18_expenses_list", "l1_fk_orphans", "d10_profit_by_product", "i2_validate_sales_orders"])
def test_no_broadcast_hints(plan, name):
    assert "BroadcastExchange" not in plan(name)


def test_names_are_fetched_for_the_winners_only(plan):
    """Each fact meets the keys of its dimension by semi-join before the limit."""
    p = plan("f1_activity_feed")
    assert p.count("LeftSemi") == 3
    assert len(re.findall("TakeOrderedAndProject", p)) >= 3


def test_orders_are_read_once_in_search(plan):
    p = plan("b11_global_search")
    assert len(re.findall(r"FileScan parquet \[o_orderkey", p)) == 1


@pytest.mark.parametrize("name", ["g1_assign_document_numbers", "i8_material_ledger"])
def test_windows_over_rows_are_cut_into_blocks(plan, name):
    """No window over the rows themselves is without a block in its partitioning."""
    p = plan(name)
    windows = re.findall(r"Window \[[^\n]*", p)
    assert windows
    for w in windows:
        rows = re.search(r"_l_|_s#|_m#", w)
        assert not rows or "_blk" in w
