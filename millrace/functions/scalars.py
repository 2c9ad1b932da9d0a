"""2H: column-expression helpers (each returns a ``Column``; all JVM-side).

None of these is a Python UDF: they are ``when`` chains, maps and arithmetic
that stay inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- H1 / H7 / H8 / H9
def sqlite_max0(x) -> Column:
    """H7: SQLite scalar ``MAX(0, x)``: NULL if x is NULL (``greatest`` would skip it)."""
    x = _c(x).cast("double")
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(0.0), x))


def line_total(qty, price) -> Column:
    """H8: quantity times unit price."""
    return _c(qty) * _c(price)


def outstanding(total, paid) -> Column:
    """H8: what is still owed on an order."""
    return _c(total) - _c(paid)


def suggested_payment(total, paid) -> Column:
    """H8: amount the payment form proposes, never below 0."""
    return F.greatest(F.lit(0.0), _c(total) - _c(paid))


def unit_profit(price, cost) -> Column:
    """H9: price minus cost."""
    return _c(price) - _c(cost)


def margin_pct(profit, revenue) -> Column:
    """H9: profit / revenue * 100, 0 when revenue is not positive."""
    return F.when(_c(revenue) > 0, _c(profit) / _c(revenue) * 100).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- H2-H4
def year_month(d) -> Column:
    """H2: ``strftime('%Y-%m', d)``."""
    return F.date_format(_c(d), "yyyy-MM")


def month_range(ym: str) -> tuple[Column, Column]:
    """First day of month ``ym`` and first day of the next one (a prunable range)."""
    start = F.to_date(F.lit(ym + "-01"))
    return start, F.add_months(start, 1)


def julian_days_between(a, b) -> Column:
    """H4: ``julianday(a) - julianday(b)`` as fractional days."""
    return (F.unix_micros(_c(a).cast("timestamp")) - F.unix_micros(_c(b).cast("timestamp"))) / F.lit(86_400_000_000.0)


# ---------------------------------------------------------------- H6 / H18
def sqlite_like_contains(col, q: str) -> Column:
    """H6: SQLite ``col LIKE '%q%'``: ASCII-only case folding, ``%``/``_`` in q stay
    wildcards and there is no escape character (so a backslash is literal)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pat = "%" + q.translate(str.maketrans(upper, lower)).replace("\\", "\\\\") + "%"
    return F.translate(_c(col), upper, lower).like(pat)


def js_contains(col, q: str) -> Column:
    """B12 helper: JS ``String(x).toLowerCase().includes(q.toLowerCase())``."""
    return F.lower(F.coalesce(_c(col), F.lit(""))).contains(q.lower())


def strip_first(col, prefixes: list[str]) -> Column:
    """Remove the first occurrence of each prefix in turn (JS ``replace`` with a string)."""
    out = _c(col)
    for p in prefixes:
        pos = F.locate(p, out)
        out = F.when(pos > 0, F.overlay(out, F.lit(""), pos, F.lit(len(p)))).otherwise(out)
    return out


def doc_number(prefix: str, n) -> Column:
    """G1 helper: prefix + number padded to at least 5 digits (never cut, unlike ``lpad``)."""
    return F.format_string(prefix + "%05d", _c(n).cast("long"))


# ---------------------------------------------------------------- H10-H13
def stock_status(qty, min_qty) -> Column:
    """0 -> empty, 0 < qty <= min -> low, otherwise ok (negative is ok)."""
    q, m = _c(qty), _c(min_qty)
    return F.when(q == 0, "empty").when((q <= m) & (q > 0), "low").otherwise("ok")


def js_round(x) -> Column:
    """JS ``Math.round``: halves go up (toward +inf), unlike Spark ``round``."""
    return F.floor(_c(x) + F.lit(0.5))


def stock_pct(qty, min_qty) -> Column:
    """``min(100, round(qty / max(2 * min, 1) * 100))``."""
    ref = F.greatest(_c(min_qty) * 2, F.lit(1))
    return F.least(F.lit(100), js_round(_c(qty) / ref * 100)).cast("long")


def size_label(ml) -> Column:
    """``-`` for NULL/0; ``ml/1000`` + ``L`` from 1000 up; else ``ml`` + ``ml``."""
    m = _c(ml)
    litres = F.rtrim(F.rtrim((m / 1000).cast("decimal(20,6)").cast("string"), F.lit("0")), F.lit("."))
    return (F.when(m.isNull() | (m == 0), "-")
            .when(m >= 1000, F.concat(litres, F.lit("L")))
            .otherwise(F.concat(m.cast("string"), F.lit("ml"))))


def size_band(ml) -> Column:
    """Product size band used for the product icon."""
    m = _c(ml)
    return (F.when(m >= 19000, "bucket").when(m >= 5000, "gallon").when(m >= 1500, "large")
            .when(m >= 600, "medium").otherwise("small"))


# Material-name keywords, checked in this order; first hit wins.
MATERIAL_KEYWORDS = [
    ("bottle", ["ขวด"]),
    ("cap", ["ฝา"]),
    ("label", ["ฉลาก"]),
    ("tank", ["ถัง"]),
    ("filter", ["สารกรอง", "กรอง"]),
    ("carbon", ["คาร์บอน"]),
    ("seal", ["ซีล"]),
]


def material_kind(name) -> Column:
    """First keyword match wins, else ``box``."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    out = None
    for kind, words in MATERIAL_KEYWORDS:
        cond = None
        for w in words:
            cond = n.contains(w) if cond is None else cond | n.contains(w)
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise("box")


# ---------------------------------------------------------------- H14
# Code -> Thai label per domain (fallback is the code itself).
LABELS: dict[str, dict[str, str]] = {
    "status": {
        "pending": "รอยืนยัน", "confirmed": "ยืนยันแล้ว", "in_progress": "กำลังผลิต", "delivered": "จัดส่งแล้ว",
        "paid": "ชำระแล้ว", "cancelled": "ยกเลิก", "completed": "เสร็จแล้ว", "in_transit": "กำลังส่ง",
        "failed": "ไม่สำเร็จ",
    },
    "customer_type": {"retail": "ขายปลีก", "wholesale": "ขายส่ง", "corporate": "บริษัท", "distributor": "ตัวแทน"},
    "role": {"admin": "ผู้ดูแลระบบ", "manager": "ผู้จัดการ", "staff": "พนักงาน"},
    "po_status": {"draft": "ร่าง", "approved": "อนุมัติ", "ordered": "สั่งแล้ว", "received": "รับแล้ว",
                  "cancelled": "ยกเลิก"},
    "expense_category": {
        "electricity": "ค่าไฟฟ้า", "water": "ค่าน้ำประปา", "labor": "ค่าแรงงาน", "fuel": "ค่าเชื้อเพลิง",
        "maintenance": "ค่าซ่อมบำรุง", "packaging": "ค่าบรรจุภัณฑ์", "transport": "ค่าขนส่ง", "rent": "ค่าเช่า",
        "other": "อื่นๆ",
    },
    "return_reason": {"damaged": "ชำรุด", "expired": "หมดอายุ", "quality": "คุณภาพไม่ผ่าน", "wrong_order": "สั่งผิด",
                      "excess": "เกิน", "other": "อื่นๆ"},
    "return_status": {"pending": "รออนุมัติ", "approved": "อนุมัติ", "rejected": "ปฏิเสธ"},
    "route_status": {"pending": "รอจัดส่ง", "in_progress": "กำลังจัดส่ง", "completed": "จัดส่งแล้ว",
                     "cancelled": "ยกเลิก"},
    "material_move": {"in": "รับเข้า", "out": "เบิกออก"},
    "payment_method": {"cash": "เงินสด", "transfer": "โอนเงิน", "check": "เช็ค"},
}
# Fallbacks that are not the code itself.
PAYMENT_METHOD_FALLBACK = "เครดิต"
MATERIAL_MOVE_FALLBACK = "เบิกออก"


def label(domain: str, code) -> Column:
    """Thai label for a code; unknown codes fall back to the code (payment
    method falls back to the credit label, a material move to the 'out' label)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(LABELS[domain].items())])
    c = _c(code)
    fallback = {"payment_method": F.lit(PAYMENT_METHOD_FALLBACK),
                "material_move": F.lit(MATERIAL_MOVE_FALLBACK)}.get(domain, c)
    return F.coalesce(m[c], fallback)


# ---------------------------------------------------------------- H15 / H17 / H19
def time_ago(ts, as_of) -> Column:
    """Coarse age text; ``as_of`` is a timestamp column or literal."""
    diff = F.floor((F.unix_micros(_c(ts).cast("timestamp")) - F.unix_micros(_c(as_of).cast("timestamp"))) * -1
                   / F.lit(1_000_000))
    return (F.when(_c(ts).isNull(), F.lit(""))
            .when(diff < 60, F.lit("เมื่อกี้"))
            .when(diff < 3600, F.concat(F.floor(diff / 60).cast("string"), F.lit(" นาทีที่แล้ว")))
            .when(diff < 86400, F.concat(F.floor(diff / 3600).cast("string"), F.lit(" ชม.ที่แล้ว")))
            .otherwise(F.concat(F.floor(diff / 86400).cast("string"), F.lit(" วันที่แล้ว"))))


# Thai short month names (Jan..Dec) used by the date format.
THAI_MONTHS = ["ม.ค.", "ก.พ.", "มี.ค.", "เม.ย.", "พ.ค.", "มิ.ย.", "ก.ค.", "ส.ค.", "ก.ย.", "ต.ค.", "พ.ย.", "ธ.ค."]


def fmt_currency(x) -> Column:
    """Baht sign, grouped thousands, two decimals (NULL -> 0)."""
    return F.concat(F.lit("฿"), F.format_number(F.coalesce(_c(x).cast("double"), F.lit(0.0)), 2))


def fmt_number(x) -> Column:
    """Grouped number (up to 3 decimals, trailing zeros dropped)."""
    s = F.format_number(F.coalesce(_c(x).cast("double"), F.lit(0.0)), 3)
    return F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))


def fmt_date(d) -> Column:
    """``d <Thai month> <Buddhist year>``; NULL -> ``-``. Display only."""
    d = _c(d).cast("date")
    months = F.array(*[F.lit(m) for m in THAI_MONTHS])
    txt = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(months, F.month(d)),
                      (F.year(d) + 543).cast("string"))
    return F.when(d.isNull(), "-").otherwise(txt)


def low_stock_message(name, qty, min_qty) -> Column:
    """Alert text ``"name" low (qty/min)``."""
    return F.format_string('"%s" เหลือ %s (ขั้นต่ำ %s)', _c(name), _c(qty).cast("string"), _c(min_qty).cast("string"))


# ---------------------------------------------------------------- aggregation helpers
# Fixed value: money carries at most 4 decimal places (prices have 2, costs at
# 75 % of a price have up to 4).
MONEY = "decimal(18,4)"


def msum_dec(x) -> Column:
    """Exact sum of money (each value taken to 4 decimals) as ``decimal(38,6)``.

    Spark's partial aggregation adds doubles in a run-dependent order, so a
    double sum changes in its last bits from run to run (and from any other
    engine). A ``decimal`` sum is exact but its wide buffer is slow to
    aggregate. Here each value is split into whole units and 1e-4 fractions,
    both summed as ``long`` (fixed-width buffers, Tungsten's fast hash map), and
    combined as a decimal once per group: exact, order-free and about as fast
    as a double sum. Whole units overflow only past 9.2e18 (an ANSI error, never
    a silent wrap)."""
    v = _c(x).cast("double")
    whole = F.floor(v)
    frac = F.rint((v - whole) * 10000).cast("long")
    return F.sum(whole).cast("decimal(38,0)") + F.sum(frac).cast("decimal(38,0)") / 10000


def msum(x) -> Column:
    """``msum_dec`` returned as a (correctly rounded) double."""
    return msum_dec(x).cast("double")


def msum0(x) -> Column:
    """``msum`` with 0 for no rows (``COALESCE(SUM(x), 0)``)."""
    return F.coalesce(msum(x), F.lit(0.0))


def mavg(x) -> Column:
    """Mean of a money/measure column from the exact sum (NULLs skipped)."""
    return F.when(F.count(_c(x)) > 0, msum(x) / F.count(_c(x)))


def count_if(cond: Column) -> Column:
    """Count of rows where ``cond`` is true (bigint, 0 on empty input)."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)).cast("long"), F.lit(0).cast("long"))


def sql_msum(x: str) -> str:
    """The oracle-side spelling of ``msum``."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


# Chart labels drop leading name prefixes, first occurrence of each in turn
# (the brand's own prefix is configuration; the generic "drinking water " is
# the default).
BRAND_PREFIXES = ["น้ำดื่ม "]
