"""Joins with one row per key, safe where one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows, so there are fewer than 1 / SHARE hot keys at any size.
SHARE = 0.001


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str | list[str], size_col: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``per_key``, which has a row per key and, in ``size_col``, the number of rows the key has.

    Hot keys are broadcast, and there are at most 1 / SHARE of them whatever the data; their rows stay where they are.
    The others meet by an ordinary join. ``how`` is inner or left. Both tables should be written ones.
    """
    keys = [key] if isinstance(key, str) else key
    limit = F.lit(max(SHARE * total, 1.0))
    hot = F.broadcast(per_key.where(F.col(size_col) > limit))
    cold = rows.join(hot, keys, "left_anti").join(per_key.where(F.col(size_col) <= limit), keys, how)
    return rows.join(hot, keys).unionByName(cold)
