"""I1 and I19 onto stored tables: a batch of changes rewrites the partitions that its keys touch.

The rules are those of ``rules.apply_changes`` and ``rules.settings_upsert``; ``sources.stored`` says how a
batch is published. What is read besides the touched partitions is the ``id`` column, for the largest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.rules import CHANGE_SPECS, apply_changes, settings_upsert
from millrace.sources.stored import StoredTable


def store_changes(table: StoredTable, batch: int, changes: DataFrame, spec: dict | str = "products", seq: str = "seq",
                  rejects_to: str | None = None) -> bool:
    """Apply ``changes`` as batch ``batch`` of ``table``; False if it was applied before. The rejects go
    to ``<rejects_to>/batch=<n>``, before the batch is published: a batch that is there has its rejects."""
    spec = CHANGE_SPECS[spec] if isinstance(spec, str) else spec
    keys = [spec["key"]] if isinstance(spec["key"], str) else list(spec["key"])
    if keys != table.keys:
        raise ValueError(f"the table is stored by {table.keys}, the changes are by {keys}")
    if table.published(batch):
        return False
    now = table.read()
    top = (now.agg(F.max("id")).first()[0] or 0) if "id" in now.columns else 0
    touched = changes.select(*keys)
    if keys == ["id"]:
        # inserts get the next ids, whose buckets hold rows of the table too
        new = changes.where(F.col("op").eqNullSafe("insert")).count()
        touched = changes.where(~F.col("op").eqNullSafe("insert")).select("id").unionByName(table.spark.range(top + 1, top + 1 + new))

    def changed(rows: DataFrame) -> DataFrame:
        state, rejects = apply_changes(rows, changes, spec, seq, top)
        if rejects_to:
            rejects.write.mode("overwrite").parquet(f"{rejects_to.rstrip('/')}/batch={batch}")
        return state

    return table.merge(batch, touched, changed)


def store_settings(table: StoredTable, batch: int, updates: DataFrame) -> bool:
    """Upsert settings into ``table`` as batch ``batch``; False if it was applied before."""
    return table.merge(batch, updates.select("key"), lambda rows: settings_upsert(rows, updates))
