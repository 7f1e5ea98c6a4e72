"""Joins whose left side may have a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HEAVY of the rows is heavy; by the pigeonhole principle there are under HEAVY.
HEAVY = 64


def join_skewed(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, of which each key has one row at most; ``how``: inner, left,
    left_semi or left_anti. Rows of heavy keys are joined by broadcasting the right rows of those keys,
    under HEAVY of them, so no task gets a whole hot key; all others by the planner's choice. ``left``
    should be cheap to read twice."""
    n = left.count()
    heavy_keys = F.broadcast(left.groupBy(key).count().where((F.col("count") > max(n // HEAVY, 1000)) & F.col(key).isNotNull()).select(key))
    heavy = left.join(heavy_keys, key, "left_semi").join(F.broadcast(right.join(heavy_keys, key, "left_semi")), key, how)
    light = left.join(heavy_keys, key, "left_anti").join(right, key, how)
    return light.unionByName(heavy)
