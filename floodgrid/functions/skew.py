"""Joins in which a few keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 200


def join_hot(rows: DataFrame, values: DataFrame, key: str | list[str], share: int = HOT_SHARE, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per key).

    Keys with over 1/``share`` of the rows, fewer than ``share`` of them, are joined by broadcast, so
    their rows stay where they are; all others by shuffle. ``rows`` is read more than once, so it
    should be a written table.
    """
    keys = [key] if isinstance(key, str) else list(key)
    count = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = F.broadcast(count.where(F.col("_n") * share > total).select(*keys))
    often = rows.join(hot, keys, "left_semi").join(F.broadcast(values.join(hot, keys, "left_semi")), keys, how)
    rest = rows.join(hot, keys, "left_anti").join(values, keys, how)
    return often.unionByName(rest)
