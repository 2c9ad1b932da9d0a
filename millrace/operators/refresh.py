"""D1, D15 and D26 as refreshed views: aggregates kept as mergeable sums, with retractions.

A view is a small table of keys and whole-number sums (money in exact 1e-4 units, and ``n``, the rows
behind a key). A change to a stored row is its old form, which is taken out, and its new form, which is
added: an insert has only a new form, a delete only an old one. Sums over both, key by key, with the view
give the refreshed view; keys without rows go. No base table is read, and changes of a hot key are added
up before they meet. Sales are kept by day, so the view serves any ``as_of``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import MONEY, count_if
from millrace.operators.reports import OPEN, _d, _one_row


def _units(c: Column) -> Column:
    return F.coalesce(F.sum((c.cast(MONEY) * 10000).cast("long")), F.lit(0).cast("long"))


def _money(c: Column) -> Column:
    return (c.cast("decimal(38,0)") / 10000).cast("double")


def _owed() -> Column:
    return F.when(~F.col("status").isin(*OPEN), F.col("total_amount") - F.col("paid_amount"))


def _rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def sales_view(o: DataFrame) -> DataFrame:
    """Sales orders by day: live revenue, orders to confirm or deliver, open amount."""
    live = F.when(F.col("status") != "cancelled", F.col("total_amount"))
    return o.groupBy("order_date").agg(_units(live).alias("live"), count_if(F.col("status").isin("pending", "confirmed")).alias("pending"),
                                       _units(_owed()).alias("owed"), _rows())


def outstanding_view(o: DataFrame) -> DataFrame:
    """Open orders by customer (D26); a view of what is open, so closed orders are no rows of it."""
    return o.where(~F.col("status").isin(*OPEN)).groupBy("customer_id").agg(_units(_owed()).alias("owed"), _rows())


def customers_view(c: DataFrame) -> DataFrame:
    return c.groupBy().agg(count_if(F.col("active") == 1).alias("active"), _rows())


def products_view(p: DataFrame) -> DataFrame:
    low = (F.col("stock") <= F.col("min_stock")) & (F.col("active") == 1)
    return p.groupBy().agg(count_if(F.col("active") == 1).alias("active"), count_if(low).alias("low"), _rows())


def production_view(po: DataFrame) -> DataFrame:
    return po.groupBy().agg(count_if(F.col("status").isin("pending", "in_progress")).alias("pending"), _rows())


def materials_view(m: DataFrame) -> DataFrame:
    return m.groupBy().agg(count_if(F.col("quantity") <= F.col("min_quantity")).alias("low"), _rows())


def refreshed(view: DataFrame, old: DataFrame, new: DataFrame, measure: Callable[[DataFrame], DataFrame],
              keys: tuple[str, ...] = ()) -> DataFrame:
    """``view`` after rows ``old`` became rows ``new``; ``measure`` is the function that made the view."""
    sums = [c for c in view.columns if c not in keys]
    taken = measure(old).select(*keys, *[(-F.col(c)).alias(c) for c in sums])
    rows = view.unionByName(taken).unionByName(measure(new))
    out = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return out.where("n <> 0") if keys else out


def dashboard(sales: DataFrame, customers: DataFrame, products: DataFrame, production: DataFrame, materials: DataFrame,
              as_of) -> DataFrame:
    """D1 from the five views."""
    day = _d(as_of)
    first = F.trunc(day, "month")
    month = (F.col("order_date") >= first) & (F.col("order_date") < F.add_months(first, 1))
    total = lambda cond, c: _money(F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    so = sales.agg(total(F.col("order_date") == day, "live").alias("today_sales"), total(month, "live").alias("month_sales"),
                   count("pending").alias("pending_orders"), total(F.lit(True), "owed").alias("unpaid_amount"))
    return _one_row(so, customers.agg(count("active").alias("total_customers")),
                    products.agg(count("active").alias("total_products"), count("low").alias("low_stock")),
                    production.agg(count("pending").alias("pending_production")), materials.agg(count("low").alias("low_materials")))


def outstanding(view: DataFrame) -> DataFrame:
    """D26 from its view."""
    return view.select("customer_id", _money(F.col("owed")).alias("outstanding"))


def receivables(c: DataFrame, view: DataFrame) -> DataFrame:
    """D15 from the customers and the view of open orders."""
    cc = c.where(F.col("active") == 1).select(F.col("id").alias("customer_id"), "code", "name", "phone", "credit_limit", "balance")
    return cc.join(outstanding(view), "customer_id", "left").withColumn(
        "outstanding", F.coalesce("outstanding", F.lit(0.0))).orderBy(F.desc("outstanding"), "customer_id")
