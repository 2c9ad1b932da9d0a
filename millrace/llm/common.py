"""Shared helpers: the query registry, table access, scratch folders and text expressions."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: words are runs of anything but the six ASCII white-space characters
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


#: rows in an Arrow batch: texts are long, and tasks hold a batch or two
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Make the package importable in tasks and keep Arrow batches of texts small, unless the session
    sets their size itself."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` as a query, with its DuckDB SQL if there is one."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: lineage ends there,
    and the files survive the loss of any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out, lambda _, key=id(out): _WRITTEN.pop(key, None)), path)
    return out


#: the folder of each frame that ``materialize`` gave and that is still in use
_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def discard(*frames: DataFrame) -> None:
    """Remove the files behind frames that ``materialize`` gave, once all that reads them is written itself."""
    for df in frames:
        kept, path = _WRITTEN.pop(id(df), (None, None))
        if kept is not None and kept() is df:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a NULL id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text: each byte is taken in, then eight bits are shifted out."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    last = f"list_reduce(list_concat([4294967295], {steps}), lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) ELSE xor(r >> 1, (r & 1) * 3988292384) END)"
    return f"xor({last}, 4294967295)"


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name = "_" + name
    return name


def texts(col: pa.Array) -> Iterator[bytes]:
    """The values of a string or binary Arrow column as UTF-8 bytes, NULL as empty."""
    for chunk in (col.chunks if isinstance(col, pa.ChunkedArray) else [col]):
        binary = pa.large_binary() if pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type) else pa.binary()
        for x in chunk.cast(binary):
            yield x.as_py() or b""


def bounded_sample(rows: DataFrame, class_col: str, id_col: str, per_class: int, parts: int = 128) -> DataFrame:
    """(id_col, class_col) of the ``per_class`` ids of each class that come first by hash, however
    often an id repeats; an id of several classes counts for the first. The first of each of
    ``parts`` parts of a class are found before the class meets in one task. The list is written, so
    that a join with it knows how short it is."""
    ids = rows.where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull()).groupBy(F.col(id_col)).agg(F.min(class_col).alias(class_col))
    ids = ids.withColumn("_h", F.xxhash64(id_col)).withColumn("_part", F.pmod("_h", F.lit(parts)))
    for by in ((class_col, "_part"), (class_col,)):
        order = Window.partitionBy(*by).orderBy("_h", id_col)
        ids = ids.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_class)
    return materialize(ids.select(id_col, class_col), "sample")
