"""Join helpers for names of users.

No dimension carries a broadcast hint, not even users: all grow with the data,
so AQE decides. At run time Spark measures the shuffled side and turns the
sort-merge join into a broadcast join only when it is under
``spark.sql.adaptive.autoBroadcastJoinThreshold``; past that it stays a
shuffle join. No driver-side count is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def users_lookup(users: DataFrame, id_col: str = "created_by", name_col: str = "created_by_name") -> DataFrame:
    """``created_by -> users.name`` lookup frame (always LEFT-joined)."""
    return users.select(F.col("id").alias(id_col), F.col("name").alias(name_col))


def with_user_name(df: DataFrame, users: DataFrame, id_col: str = "created_by",
                   name_col: str = "created_by_name") -> DataFrame:
    """Left-join the creator's name."""
    return df.join(users_lookup(users, id_col, name_col), on=id_col, how="left")
