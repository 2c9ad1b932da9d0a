"""The stock ledger as a keyed state of Spark's own state store.

Each material that has moved has one value state, its balance in 1e-4 units; a material without one
starts from its opening stock, which comes with the rows. A batch reads and writes the states of its
own materials only (RocksDB with a changelog, so what a batch writes follows its keys), and Spark
restores them after a failure. A material's rows of one batch are taken in order of time and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

UNIT = 10_000
LEDGER_SCHEMA = "id long, material_id long, accepted boolean, reason string, balance double, alert string"
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class StockLedger(StatefulProcessor):
    """``clamp`` False: the manual adjustment rule (I9), which refuses what is not there; True: the
    production-use rule (I8), which stops at zero. ``alert`` (J3): ``out`` when stock reaches 0, ``low``
    when it crosses down through the material's minimum."""

    def __init__(self, clamp: bool):
        self.clamp = clamp

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("balance", "units long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        moves = pd.concat(list(rows)).sort_values(["created_at", "id"])
        first = moves.iloc[0]
        held = self.state.get()[0] if self.state.exists() else int(first.opening)
        minimum = float(first.minimum) if first.has_minimum else None
        out = []
        for move, valid, units in zip(moves.id, moves.valid, moves.units):
            before, reason = held, None
            if self.clamp:
                held = held + units if units > 0 else max(0, held + units)
            elif not valid:
                reason = "bad_quantity"
            elif not first.known:
                reason = "unknown_material"
            elif held + units < 0:
                reason = "insufficient_stock"
            else:
                held += units
            alert = "out" if held == 0 != before else (
                "low" if minimum is not None and held / UNIT <= minimum < before / UNIT else None)
            nowhere = not self.clamp and not first.known
            out.append((move, reason is None, reason, None if nowhere else held / UNIT, None if nowhere else alert))
        if first.known or self.clamp:
            self.state.update((int(held),))
        frame = pd.DataFrame(out, columns=["id", "accepted", "reason", "balance", "alert"])
        frame.insert(1, "material_id", pd.array([key[0]] * len(frame), "Int64"))
        yield frame

    def close(self) -> None:
        pass


def ledger_stream(moves: DataFrame, materials: DataFrame, mode: str = "reject") -> DataFrame:
    """Streaming ``moves(id, material_id, type, quantity, created_at)`` with ``materials(id, quantity,
    min_quantity)`` -> LEDGER_SCHEMA. Opening stock and minimum are those of the batch's time."""
    units = lambda c: F.coalesce((F.col(c).cast("decimal(18,4)") * UNIT).cast("long"), F.lit(0).cast("long"))
    has_min = F.col("min_quantity") if "min_quantity" in materials.columns else F.lit(None).cast("double")
    known = materials.select(F.col("id").alias("_m"), units("quantity").alias("opening"), has_min.cast("double").alias("minimum"))
    x = moves.join(known, F.col("material_id") == F.col("_m"), "left")
    valid = F.coalesce(F.col("quantity") > 0, F.lit(False))
    amount = units("quantity") if mode == "clamp" else F.when(valid, units("quantity")).otherwise(F.lit(0).cast("long"))
    x = x.select("id", "material_id", "created_at", valid.alias("valid"), F.when(F.col("type") == "in", amount).otherwise(-amount).alias("units"),
                 F.col("_m").isNotNull().alias("known"), F.coalesce("opening", F.lit(0).cast("long")).alias("opening"),
                 F.col("minimum").isNotNull().alias("has_minimum"), F.coalesce("minimum", F.lit(0.0)).alias("minimum"))
    return x.groupBy("material_id").transformWithStateInPandas(
        StockLedger(mode == "clamp"), outputStructType=LEDGER_SCHEMA, outputMode="Append", timeMode="None")


def use_state_store(spark: SparkSession) -> None:
    """The state store that the ledger needs, for streams that start from now on."""
    for key, value in _STORE.items():
        spark.conf.set(key, value)
