"""Spark session defaults for millrace jobs.

Everything that changes results is pinned here: the session time zone is UTC
(the reference stores `CURRENT_TIMESTAMP` as UTC text), AQE is on so joins
against dimensions that are larger than expected fall back from broadcast to
sort-merge at run time, and skew-join splitting is on for hot keys.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "millrace", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster, leave ``master`` as None and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 - Spark Connect
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we never invent one on a cluster.
    Only a local-mode session (tests, bench) without the setting gets a fresh
    scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's setting is all there is
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder") from None
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="millrace-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``millrace`` importable in the session's Python workers.

    Python code that runs inside tasks (``mapInPandas`` folds, the streaming
    state function) is imported by the workers. On a cluster ship the package
    with ``spark-submit --py-files millrace.zip``; for a local session that was
    started elsewhere this zips the package once and adds it with
    ``addPyFile``."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: code is shipped by the client/server setup
        return
    if sc.applicationId in _SHIPPED or not sc.master.startswith("local"):
        return
    import shutil

    import millrace
    root = os.path.dirname(os.path.dirname(os.path.abspath(millrace.__file__)))
    d = tempfile.mkdtemp(prefix="millrace-pkg-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.addPyFile(shutil.make_archive(os.path.join(d, "millrace"), "zip", root_dir=root, base_dir="millrace"))
    _SHIPPED.add(sc.applicationId)
