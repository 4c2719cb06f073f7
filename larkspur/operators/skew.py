"""Joins whose keys may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer keys than this are broadcast, whatever the data.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], total: int, count: str = "n") -> DataFrame:
    """``rows`` joined with ``keys``, which has one row for each key and, as ``count``, the
    key's number of ``rows``; ``total`` is no less than the number of ``rows``.

    Keys of more than ``total / HOT_KEYS`` rows, of which counting allows fewer than
    ``HOT_KEYS``, are broadcast, so their rows stay where they are; the others are shuffled,
    and one of them gives a task at most that many rows.  Rows with a null in ``on`` match
    nothing; no row is dropped otherwise.
    """
    hot = F.coalesce(F.col(count) > total // HOT_KEYS, F.lit(False))
    frequent = F.broadcast(keys.where(hot).drop(count))
    rare = keys.where(~hot).drop(count)
    return rows.join(frequent, on).unionByName(rows.join(F.broadcast(keys.where(hot).select(*on)), on, "left_anti").join(rare, on))
