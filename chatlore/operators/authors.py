"""User-name resolution (C2): a left lookup join with a match flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlore.functions.text import author_name
from chatlore.sources.chat import dedup_users


def resolve(df: DataFrame, users: DataFrame, user_col: str, out_col: str) -> DataFrame:
    """Add ``out_col`` = display name of ``user_col``.

    Empty or null id -> ``Unknown``; id found -> its real name (kept even when
    empty); id not found -> the id itself; an id listed twice counts once.  A ``matched`` flag, not
    ``coalesce``, separates "found with a null name" from "not found".  The
    join is a plain equi join: AQE broadcasts the directory when its measured
    size is under the broadcast threshold and shuffles both sides otherwise.
    """
    lookup = dedup_users(users).select(
        F.col("user_id").alias("_uid"),
        F.col("real_name").alias("_real_name"),
        F.lit(True).alias("_matched"),
    )
    joined = df.join(lookup, df[user_col] == lookup["_uid"], "left")
    return joined.withColumn(
        out_col, author_name(F.col(user_col), F.coalesce(F.col("_matched"), F.lit(False)), F.col("_real_name"))
    ).drop("_uid", "_real_name", "_matched")
