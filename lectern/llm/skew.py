"""Joins of rows with one entry a key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key of at least so many rows, and of at least one row in 50,000, is hot: there are at most 50,000 of those.
HOT, HOT_KEYS = 100_000, 50_000


def join_entries(rows: DataFrame, entries: DataFrame, key: str, size: Column, total: int) -> DataFrame:
    """``rows`` with the columns of their entry, null where there is none. ``size`` is how many rows an entry may meet.

    Rows of a hot key never meet: its entry, one of at most HOT_KEYS, goes to them. Other keys are joined as any.
    """
    hot = size >= max(HOT, total // HOT_KEYS)
    mark = "_hot"
    told = rows.join(F.broadcast(entries.where(hot).withColumn(mark, F.lit(True))), key, "left")
    rest = told.where(F.col(mark).isNull()).select(*(F.col(f"`{c}`") for c in rows.columns)).join(entries.where(~hot), key, "left")
    return told.where(mark).drop(mark).unionByName(rest)
