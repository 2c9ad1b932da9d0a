"""2B projections / filters / predicates and 2E sorts and top-k.

Filters are plain Column predicates on stored columns, so Catalyst pushes
them into the Parquet scan. Every list order ends with ``id`` because the
reference leaves ties open. ``limit`` appears only where the top-k *is* the
feature (alerts, search, audit); Spark plans ``orderBy().limit()`` as
TakeOrderedAndProject (a per-partition top-k, then a k-row merge).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import js_contains, sqlite_like_contains


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.to_date(F.lit(str(x)))


# ----------------------------------------------------------------------------- B1-B3
def active_only(df: DataFrame, order: str = "code") -> DataFrame:
    """B1: soft-deleted rows hidden, listed by code."""
    return df.where(F.col("active") == 1).orderBy(order, "id")


def materials_list(m: DataFrame) -> DataFrame:
    """B2: all materials by code (materials are hard-deleted)."""
    return m.orderBy("code", "id")


def equipment_list(e: DataFrame) -> DataFrame:
    """B2: all equipment by code."""
    return e.orderBy("code", "id")


USER_PUBLIC = ["id", "username", "name", "role", "active"]


def users_public(u: DataFrame) -> DataFrame:
    """Users without the password column, by id."""
    return u.select(*[c for c in USER_PUBLIC if c in u.columns]).orderBy("id")


# ----------------------------------------------------------------------------- B4-B7
def sales_filter(o: DataFrame, status: str | None = None, date_from=None, date_to=None,
                 customer_id=None) -> DataFrame:
    """Optional ANDed predicates; a falsy parameter means no filter."""
    if status:
        o = o.where(F.col("status") == status)
    if date_from:
        o = o.where(F.col("order_date") >= _d(date_from))
    if date_to:
        o = o.where(F.col("order_date") <= _d(date_to))
    if customer_id:
        o = o.where(F.col("customer_id") == customer_id)
    return o


def expenses_filter(e: DataFrame, date_from=None, date_to=None, category: str | None = None) -> DataFrame:
    """The same for expenses."""
    if date_from:
        e = e.where(F.col("expense_date") >= _d(date_from))
    if date_to:
        e = e.where(F.col("expense_date") <= _d(date_to))
    if category:
        e = e.where(F.col("category") == category)
    return e


def expenses_of_month(e: DataFrame, ym: str) -> DataFrame:
    """Expenses whose date starts with ``YYYY-MM`` (as a prunable date range)."""
    lo = dt.date.fromisoformat(ym + "-01")
    hi = (lo.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return e.where((F.col("expense_date") >= F.lit(lo)) & (F.col("expense_date") < F.lit(hi)))


def status_filter(df: DataFrame, statuses: Sequence[str] | str, negate: bool = False,
                  col: str = "status") -> DataFrame:
    """Status IN / NOT IN a set (NULL status never matches either, as in SQL)."""
    statuses = [statuses] if isinstance(statuses, str) else list(statuses)
    cond = F.col(col).isin(*statuses)
    return df.where(~cond if negate else cond)


# ----------------------------------------------------------------------------- B8-B10
def low_stock(df: DataFrame, qty: str = "stock", min_col: str = "min_stock", k: int | None = 10,
              require_active: bool | None = None) -> DataFrame:
    """``qty <= min`` (products must also be active), lowest first; top ``k``."""
    x = df.where(F.col(qty) <= F.col(min_col))
    if require_active if require_active is not None else "active" in df.columns:
        x = x.where(F.col("active") == 1)
    x = x.orderBy(F.col(qty).asc(), "id")
    return x.limit(k) if k else x


def overdue_orders(o: DataFrame, c: DataFrame, as_of, k: int | None = 10) -> DataFrame:
    """Open orders whose due date is before ``as_of``, with the customer name."""
    x = o.where(~F.col("status").isin("paid", "cancelled") & F.col("due_date").isNotNull()
                & (F.col("due_date") < _d(as_of)))
    # only orders that have a customer count; the winners alone fetch the name
    x = x.join(c.select(F.col("id").alias("customer_id")), "customer_id", "left_semi")
    if k:
        x = x.orderBy("due_date", "id").limit(k)
    x = x.join(c.select(F.col("id").alias("customer_id"), F.col("name").alias("customer")), "customer_id")
    return x.select("id", "order_number", "customer", "due_date").orderBy("due_date", "id")


def maintenance_due(e: DataFrame, as_of, days: int = 7, active_only: bool = True) -> DataFrame:
    """Equipment due for maintenance within ``days``.

    ``active_only=True`` is the server rule (status active); False is the UI
    card rule (any status). Empty-string dates must be NULLed at ingest (A2)."""
    x = e.where(F.col("next_maintenance").isNotNull() & (F.col("next_maintenance") <= F.date_add(_d(as_of), days)))
    if active_only:
        x = x.where(F.col("status") == "active")
    return x.orderBy("next_maintenance", "id")


# ----------------------------------------------------------------------------- B11-B14
def global_search(customers: DataFrame, products: DataFrame, orders: DataFrame, q: str, k: int = 5,
                  buyers: DataFrame | None = None) -> DataFrame:
    """SQLite-LIKE search over three groups, ``k`` hits each, one frame with
    a ``grp`` column. Empty (trimmed) text gives an empty frame. ``buyers`` names the
    orders' customers, where ``customers`` holds only those to be searched."""
    q = (q or "").strip()
    cust = customers.where((sqlite_like_contains("name", q) | sqlite_like_contains("code", q)
                            | sqlite_like_contains("phone", q)) & (F.col("active") == 1)) \
        .orderBy("id").limit(k).select(F.lit("customers").alias("grp"), "id", "code", "name", "phone", "type")
    prod = products.where((sqlite_like_contains("name", q) | sqlite_like_contains("code", q)) & (F.col("active") == 1)) \
        .orderBy("id").limit(k).select(F.lit("products").alias("grp"), "id", "code", "name", "stock", "unit", "price")
    # orders hit by number or by their customer's name: one join, then the filter
    cn = (customers if buyers is None else buyers).select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    hits = orders.join(cn, "customer_id").where(sqlite_like_contains("order_number", q) | sqlite_like_contains("customer_name", q))
    ords = hits.orderBy(F.desc("created_at"), F.desc("id")).limit(k) \
        .select(F.lit("orders").alias("grp"), "id", F.col("order_number").alias("code"), "total_amount", "status",
                "order_date", "customer_name")
    out = cust.unionByName(prod, allowMissingColumns=True).unionByName(ords, allowMissingColumns=True)
    return out if q else out.where(F.lit(False))


def contains_filter(df: DataFrame, cols: Sequence[str], q: str, type_value: str | None = None) -> DataFrame:
    """Client-side search: full Unicode lower-case substring, no wildcards;
    NULL columns count as empty text; optional exact ``type`` filter."""
    if q:
        cond = None
        for c in cols:
            cond = js_contains(c, q) if cond is None else cond | js_contains(c, q)
        df = df.where(cond)
    if type_value:
        df = df.where(F.col("type") == type_value)
    return df


def batches_with_number(po: DataFrame) -> DataFrame:
    """Production orders that carry a batch number."""
    return po.where(F.col("batch_number").isNotNull() & (F.col("batch_number") != ""))


def date_range_default(date_from: str | None, date_to: str | None, as_of) -> tuple[str, str]:
    """Missing ``from`` = first of the ``as_of`` month, missing ``to`` = ``as_of``."""
    day = dt.date.fromisoformat(str(as_of)[:10])
    return (date_from or day.replace(day=1).isoformat(), date_to or day.isoformat())


# ----------------------------------------------------------------------------- 2E
def top_k(df: DataFrame, keys: Sequence[Column | str], k: int) -> DataFrame:
    """ORDER BY keys LIMIT k (TakeOrderedAndProject)."""
    return df.orderBy(*keys).limit(k)


def audit_latest(a: DataFrame, k: int = 200) -> DataFrame:
    """Newest ``k`` audit rows."""
    return a.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def multi_key_sort(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Multi-key sort with ``id`` as the final tie-break."""
    return df.orderBy(*keys, F.desc("id"))
