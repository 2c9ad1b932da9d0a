"""Tables that change batch by batch: key-hash partitions, of which a batch rewrites the touched ones only.

``<path>/batch=<n>/_bucket=<b>/`` holds the rows of bucket ``b`` as batch ``n`` left them; a bucket's rows
are those of the last batch that touched it. A batch is one Spark write into a folder of its own, and
counts once Spark's commit has put ``_SUCCESS`` there, the last thing it does: readers see all of a batch or
nothing, nothing that is being read is ever overwritten, and what a lost driver leaves behind is replaced
when the batch runs again. Batches carry ascending numbers of the caller (a streaming batch's id);
a number up to the newest published one is a replay and does nothing. There is one writer at a time.

Each touched bucket gets a marker row, so a bucket whose last row goes is empty and not as before.
The driver handles bucket numbers and folder names only, of both as many as ``buckets`` bounds after ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = ("_bucket", "_row", "batch")


class StoredTable:
    """A stored table of rows with key columns ``keys``, in ``buckets`` partitions by the keys' hash,
    whose files are sorted by ``sort`` (filters on it skip row groups)."""

    def __init__(self, spark: SparkSession, path: str, keys: Iterable[str], buckets: int = 64,
                 sort: Iterable[str] = ()):
        self.spark, self.path, self.keys, self.buckets, self.sort = spark, path.rstrip("/"), list(keys), buckets, list(sort)
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        """The bucket of a row, from its key columns; keys of one value in different types share it."""
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _folders(self, where: str, name: str) -> list[int]:
        if not self._fs.exists(self._at(where)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(where)) if s.isDirectory()]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(name + "="))

    def batches(self) -> list[int]:
        """The published batches, ascending."""
        return [n for n in self._folders(self.path, "batch") if self._fs.exists(self._at(f"{self.path}/batch={n}/_SUCCESS"))]

    def published(self, batch: int) -> bool:
        """Whether ``batch`` has been applied (its files may have been replaced since)."""
        done = self.batches()
        return bool(done) and batch <= done[-1]

    def current(self) -> dict[int, int]:
        """For each bucket the batch that holds it."""
        return {b: n for n in self.batches() for b in self._folders(f"{self.path}/batch={n}", "_bucket")}

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of the table, or of the buckets ``only``, as the newest batch left them."""
        held = self.current()
        if not held:
            raise ValueError(f"no batch has been published in {self.path}")
        newest = max(held.values())
        schema = self.spark.read.parquet(*[f"{self.path}/batch={n}/_bucket={b}" for b, n in held.items() if n == newest][:1]).schema
        wanted = held if only is None else {b: held[b] for b in only if b in held}
        if not wanted:
            return self.spark.createDataFrame([], schema).drop("_row")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/batch={n}/_bucket={b}" for b, n in sorted(wanted.items())])
        return rows.where("_row").drop("_row")

    def load(self, batch: int, rows: DataFrame) -> bool:
        """Publish ``rows`` as the whole table."""
        return not self.published(batch) and self._publish(batch, rows, range(self.buckets))

    def merge(self, batch: int, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Publish ``change(rows)`` in place of the rows that share a bucket with a key of ``touched``;
        False if the batch was published before. ``change`` gives no row of any other bucket."""
        if self.published(batch):
            return False
        numbers = sorted(r[0] for r in touched.select(self.bucket()).distinct().collect())
        return self._publish(batch, change(self.read(numbers)), numbers)

    def _publish(self, batch: int, rows: DataFrame, numbers: Iterable[int]) -> bool:
        taken = sorted(set(_OWN) & set(rows.columns))
        if taken:
            raise ValueError(f"columns {taken} are taken")
        numbers = list(numbers)
        b = self.bucket()
        rows = rows.withColumns({"_row": F.lit(True), "_bucket": F.when(b.isin(numbers), b).otherwise(
            F.raise_error(F.lit("a row outside the touched buckets")).cast("int"))})
        marks = self.spark.createDataFrame([(n, False) for n in numbers], "_bucket int, _row boolean")
        rows.unionByName(marks, allowMissingColumns=True).repartition("_bucket").sortWithinPartitions(
            "_bucket", *self.sort).write.mode("overwrite").option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy("_bucket").parquet(f"{self.path}/batch={batch}")
        return True

    def vacuum(self) -> int:
        """Delete what later batches have replaced, and return how many partitions went. Readers that
        began before the newest batch may still need them, so run it when there are none."""
        held, gone = self.current(), 0
        done = self.batches()
        for n in done:
            for b in self._folders(f"{self.path}/batch={n}", "_bucket"):
                if held[b] != n:
                    self._fs.delete(self._at(f"{self.path}/batch={n}/_bucket={b}"), True)
                    gone += 1
            if n != done[-1] and n not in held.values():
                self._fs.delete(self._at(f"{self.path}/batch={n}"), True)
        return gone
