"""Write an N-times copy of a driver scale factor (for scale rehearsals only).

    python scripts/make_scaled_copy.py /root/testdata/sf0.1 /tmp/run-xyz/sf1.0 10 [hot]

Copy k shifts every surrogate key by k * (max key + 1) so keys stay unique and
joins stay 1:1 per copy; nation/region are copied once; event user ids are
kept, so per-user (order/material) groups grow with N - a skew rehearsal.
With ``hot``, a third of all events also get user id 0 (one hot material,
order and customer), the worst case the operators are designed for.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from millrace.session import get_session  # noqa: E402
from millrace.sources.tables import load_table  # noqa: E402

KEYS = {
    "customer": {"c_custkey": "customer"},
    "supplier": {"s_suppkey": "supplier"},
    "part": {"p_partkey": "part"},
    "orders": {"o_orderkey": "orders", "o_custkey": "customer"},
    "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
    "events": {"event_id": "events"},
}
BASE = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
        "events": "event_id"}


def main(src, dst, n, hot=False):
    spark = get_session("local[8]", 16)
    span = {t: load_table(spark, src, t).agg(F.max(c)).first()[0] + 1 for t, c in BASE.items()}
    for t in ["region", "nation"]:
        load_table(spark, src, t).write.mode("overwrite").parquet(f"{dst}/{t}.parquet")
    for t, cols in KEYS.items():
        df = load_table(spark, src, t)
        out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        for c, base in cols.items():
            out = out.withColumn(c, F.col(c) + F.col("_k") * F.lit(span[base]))
        if hot and t == "events":
            out = out.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
        out.drop("_k").write.mode("overwrite").parquet(f"{dst}/{t}.parquet")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]), len(sys.argv) > 4 and sys.argv[4] == "hot")
