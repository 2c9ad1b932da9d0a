"""The registered queries: one per operator, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` binds the factory tables onto the
driver tables and calls the library op with fixed parameters; ``ORACLES[name]``
is the same question in plain SQL over the same bindings (inlined as CTEs by
``with_bindings``). Names are ``<survey id>_<op name>``.

Fixed clocks: orders-based ops use ``2000-01-31`` (midnight), events-based ops
``2024-01-20``. Period reports cover the whole data range, so every query reads
its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import ship_package
from millrace.sources.bindings import Tables, with_bindings

AS_OF = "2000-01-31"
AS_OF_EVENTS = "2024-01-20"
FROM, TO = "1995-01-01", "2001-12-31"
EV_FROM, EV_TO = "2024-01-01", "2024-01-31"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: the oracles before the bindings are put in front, to build others from
PLAIN: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: ``fn(t: Tables) -> DataFrame`` becomes ``(spark, sf_dir) -> DataFrame``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # all clocks are UTC (the reference stores UTC text; the oracles run in UTC)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return fn(Tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            PLAIN[name] = oracle.strip()
            ORACLES[name] = with_bindings(PLAIN[name])
        return fn
    return deco


def _load_all():
    """Import the modules that register queries (kept lazy to avoid cycles)."""
    from millrace.plans import (q_feeds, q_filters, q_lists, q_quality, q_reports,  # noqa: F401
                                q_rules, q_scalars, q_sources, q_streaming)
