"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it holds at least this part (one in so many) of all rows; so many keys at most are hot.
HOT_SHARE = 10_000


def attach(rows: DataFrame, known: DataFrame, key: str, total: int) -> DataFrame:
    """The rows with what is known of their keys: (key, n, ...), n being the number of rows of the key.

    Hot keys are joined by broadcast, so that none of them is a task of its own; the others by a shuffle.  ``total`` is the number of all
    rows, so at most HOT_SHARE keys are broadcast; ``known`` is a written table, read twice.
    """
    hot = known.where(F.col("n") * HOT_SHARE >= total)
    cold = known.where(F.col("n") * HOT_SHARE < total)
    by_broadcast = rows.join(F.broadcast(hot), key)
    return rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key).unionByName(by_broadcast)
