"""2A sources and sinks: ingest clean-up, schema evolution, CSV and JSON reports.

Reports are written by ``report_sink`` (one file per task, no coalesce to one
task): a CSV report is its header row plus data rows sorted by a key, so the
files, read in name order, are the exact file the reference produces.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.report_sink import write_report

BOM = "﻿"


def normalize_input(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """A2: form-input clean-up. Strings are trimmed and ``''`` becomes NULL;
    numbers are parsed with ``try_cast`` and fall back to 0 (JS ``parseFloat(x)
    || 0``); dates parse or become NULL; listed defaults fill NULLs."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name not in df.columns:
            cols.append(F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name))
            continue
        raw = F.nullif(F.trim(F.col(f.name).cast("string")), F.lit(""))
        if isinstance(f.dataType, T.StringType):
            c = raw
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.DecimalType)):
            parsed = raw.try_cast(f.dataType)
            c = F.coalesce(parsed, F.lit(0).cast(f.dataType)) if f.name not in defaults else parsed
        else:
            c = raw.try_cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def evolve_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """A3: add the target's missing columns as typed NULLs; existing columns stay."""
    out = df
    for f in target.fields:
        if f.name not in df.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out


def _cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), '"', '""'), F.lit('"'))


def csv_lines(df: DataFrame, cells: list[Column], headers: list[str],
              order: list[tuple[Column | str, bool]]) -> DataFrame:
    """A4: the CSV report as text lines: every cell quoted, ``"`` doubled, the
    header first with a UTF-8 BOM. Returns ``(_h, _o0.., line)``: ``_h`` is 0 for
    the header and 1 for data rows; ``_o*`` are the data rows' sort keys, given
    as ``(column, ascending)`` pairs."""
    spark = df.sparkSession
    head = spark.range(1).select(F.lit(0).alias("_h"),
                                 F.concat(F.lit(BOM), F.concat_ws(",", *[_cell(F.lit(h)) for h in headers])).alias("line"))
    body = df.select(F.lit(1).alias("_h"),
                     *[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, (o, _) in enumerate(order)],
                     F.concat_ws(",", *[_cell(c) for c in cells]).alias("line"))
    return head.unionByName(body, allowMissingColumns=True)


def export_csv(df: DataFrame, path: str, cells: list[Column], headers: list[str],
               order: list[tuple[Column | str, bool]]) -> bool:
    """A4: write the CSV report in row order; nothing is written when there are
    no data rows. Tasks write their sorted rows, the sink's commit puts BOM and
    header in front: the files read in name order are the report. Returns whether
    there is one."""
    sort = [(F.col(o) if isinstance(o, str) else o) for o, _ in order]
    body = df.orderBy(*[c.asc() if up else c.desc() for c, (_, up) in zip(sort, order)])
    head = BOM + ",".join('"' + h.replace('"', '""') + '"' for h in headers) + "\n"
    lines = body.select(F.concat_ws(",", *[_cell(c) for c in cells]).alias("line"), F.lit(False).alias("item"))
    return write_report(lines, path, head, skip_if_empty=True)


# The two report exports (header labels as the reference writes them).
SALES_CSV_HEADERS = ["สินค้า", "จำนวน", "ยอดขาย"]
PROFIT_CSV_HEADERS = ["สินค้า", "จำนวน", "รายได้", "ต้นทุน", "กำไร", "มาร์จิ้น"]


@dataclass(frozen=True)
class Part:
    """One field of a report: an ``object`` (a one-row frame), an ``array`` of rows in the order of
    ``order`` (unique keys, as for ``orderBy``), or a ``value`` (a one-row, one-column frame)."""
    name: str
    kind: str
    rows: DataFrame
    order: tuple[Column, ...] = ()


def report_json_lines(parts: list[Part], meta: dict[str, str]) -> DataFrame:
    """A5: a report as the lines of one JSON object ``{part: ..., from: ..., to: ...}``: a line per
    row, in order of ``(_part, _step, _pos)``, with the row's own JSON in ``json``; ``item`` marks the
    rows of arrays, which the sink separates by commas. No array is gathered into one row or task: an
    array's lines are sorted where Spark sorts them."""
    spark = parts[0].rows.sparkSession
    fields = [(f"{',' if i else '{'}{json.dumps(p.name)}:", p) for i, p in enumerate(parts)]
    tail = "".join(f",{json.dumps(k)}:{json.dumps(v, ensure_ascii=False)}" for k, v in meta.items()) + "}"
    marks = [(i, 0, head + ("[" if p.kind == "array" else "")) for i, (head, p) in enumerate(fields)]
    marks += [(i, 2, "]") for i, (_, p) in enumerate(fields) if p.kind == "array"] + [(len(fields), 0, tail)]
    out = spark.createDataFrame(marks, "_part int, _step int, line string").select(
        "_part", "_step", F.lit(0).cast("long").alias("_pos"), F.lit(None).cast("string").alias("part"),
        F.lit(None).cast("string").alias("json"), "line", F.lit(False).alias("item"))
    for i, (_, p) in enumerate(fields):
        rows = p.rows.orderBy(*p.order) if p.order else p.rows
        text = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"})
        if p.kind == "value":
            text = F.get_json_object(text, f"$.{rows.columns[0]}")
        body = rows.select(F.lit(i).alias("_part"), F.lit(1).alias("_step"), F.monotonically_increasing_id().alias("_pos"),
                           F.lit(p.name).alias("part"), text.alias("json"))
        out = out.unionByName(body.withColumns({"line": F.col("json"), "item": F.lit(p.kind == "array")}))
    return out


def export_json(parts: list[Part], meta: dict[str, str], path: str) -> None:
    """A5: write the report; the files read in name order are one JSON object."""
    write_report(report_json_lines(parts, meta).orderBy("_part", "_step", "_pos"), path)
