"""Row order of the sorted lists: the query's rows as they come against its oracle, sorted by SQL."""

import pytest

import __spark_entry__ as E
from duck_oracle import duck

#: query -> (ORDER BY of its definition, columns that tell the order)
ORDERED = {
    "b1_active_products": ("code, id", ["id"]), "b2_materials_list": ("code, id", ["id"]),
    "c1_sales_list_filtered": ("created_at DESC, id DESC", ["id"]), "c2_recent_orders": ("created_at DESC, id DESC", ["id"]),
    "d12_expenses_by_category": ("is_total, total DESC, category", ["category", "is_total"]),
    "d13_expenses_by_month": ("month", ["month"]), "b9_overdue_orders": ("due_date, id", ["id"]),
    "e3_multi_key_sort": ("expense_date DESC, created_at DESC", ["expense_date", "created_at"]),
    "f1_activity_feed": ("created_at DESC, source_rank, id DESC", ["source_rank", "id"]),
    "b10_maintenance_due": ("next_maintenance, id", ["id"]),
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_rows_come_in_order(spark, sf_dir, name):
    if name not in E.queries():
        pytest.fail(f"no query {name}")
    by, cols = ORDERED[name]
    want = duck(sf_dir).execute(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()[name]}) q ORDER BY {by}").fetchall()
    got = [tuple(r) for r in E.queries()[name](spark, sf_dir).select(*cols).collect()]
    assert got == [tuple(r) for r in want] and got
