"""Joins whose frequent keys don't end up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skew_join(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """big joined with small, which has one row per key and in weight how many rows of big have it; they sum to total at most.

    Keys with more than a share-th of the rows are fewer than share, so they may be broadcast: no task gets all rows of one. Others
    are shuffled. how is inner or left."""
    least = max(1, total // share)
    hot = small.where(F.col(weight) > least)
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.where(F.col(weight) <= least), key, how)
    return big.join(F.broadcast(hot), key).unionByName(cold)
