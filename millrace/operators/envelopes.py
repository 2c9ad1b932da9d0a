"""A5: the seven reports as envelopes, the fields in the reference's shape and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lists as C
from millrace.operators import numbering as G
from millrace.operators import reports as R
from millrace.operators.filters import active_only, materials_list
from millrace.sources.io import Part


def report(t, name: str, date_from: str, date_to: str, as_of_ts: str | None = None) -> tuple[list[Part], dict[str, str]]:
    """(fields, from / to) of the report ``name`` over the tables ``t``."""
    period = {"from": date_from, "to": date_to}
    span = (date_from, date_to)
    if name == "sales":
        o = t.sales_orders
        return [Part("summary", "object", R.sales_summary(o, *span)),
                Part("byDay", "array", R.sales_by_day(o, *span), (F.col("date"),)),
                Part("byProduct", "array", R.sales_by_product(o, t.sales_items, t.products, *span), (F.desc("revenue"), F.col("product_id"))),
                Part("byCustomer", "array", R.sales_by_customer(o, t.customers, *span), (F.desc("revenue"), F.col("customer_id")))], period
    if name == "inventory":
        v = R.inventory_valuation(t.products, t.raw_materials)
        return [Part("products", "array", active_only(t.products), (F.col("code"), F.col("id"))),
                Part("materials", "array", materials_list(t.raw_materials), (F.col("code"), F.col("id"))),
                Part("productValue", "value", v.select("product_value")), Part("materialValue", "value", v.select("material_value"))], {}
    if name == "production":
        return [Part("orders", "array", C.production_report_rows(t.production_orders, t.products, t.users, *span),
                     (F.desc("created_at"), F.desc("id"))),
                Part("summary", "object", R.production_summary(t.production_orders, *span))], period
    if name == "profit":
        by = R.profit_by_product(t.sales_orders, t.sales_items, t.products, *span)
        return [Part("byProduct", "array", by, (F.desc("profit"), F.col("product_id"))),
                Part("total", "object", R.profit_total(by).select("revenue", "cost", "profit"))], period
    if name == "expenses":
        by = R.expenses_by_category(t.expenses, *span, with_total=False).drop("is_total")
        return [Part("byCategory", "array", by, (F.desc("total"), F.col("category"))),
                Part("total", "value", R.expenses_by_category(t.expenses, *span).where("is_total").select("total")),
                Part("byMonth", "array", R.expenses_by_month(t.expenses, *span), (F.col("month"),))], period
    if name == "credit":
        return [Part("customers", "array", R.receivables_by_customer(t.customers, t.sales_orders), (F.desc("outstanding"), F.col("customer_id"))),
                Part("aging", "array", R.receivables_aging(t.sales_orders, t.customers, as_of_ts), (F.desc("d90plus"), F.col("customer_id")))], {}
    if name == "qc":
        tests = C.qc_list(R.qc_in(t.water_quality_tests, *span), G.assign_batch_numbers(t.production_orders), t.products, t.users)
        return [Part("tests", "array", tests, (F.desc("test_date"), F.desc("id"))),
                Part("summary", "array", R.qc_summary(t.water_quality_tests, *span), (F.col("result"),)),
                Part("avgValues", "object", R.qc_averages(t.water_quality_tests, *span))], period
    raise KeyError(name)


REPORTS = ("sales", "inventory", "production", "profit", "expenses", "credit", "qc")
