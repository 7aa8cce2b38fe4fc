"""Joins that a hot key cannot slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that has more than one in so many of all rows (and more than HOT_ROWS) is hot; so there are never more hot keys than that.
HOT_KEYS, HOT_ROWS = 10_000, 1_000


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with counted: one row for each key, with the number of rows that have it as ``_rows`` (left out of the result).

    total is the number of all rows. Hot keys, HOT_KEYS at most by their definition, are sent to all
    executors, so their rows stay where they are; all others meet in a shuffle join. Rows with a null in a
    key join nothing. how is inner or left.
    """
    hot = F.col("_rows") > max(total // HOT_KEYS, HOT_ROWS)
    first, other = counted.where(hot).drop("_rows"), counted.where(~hot).drop("_rows")
    met = rows.join(F.broadcast(first), on)
    rest = rows.join(F.broadcast(first.select(*on)), on, "left_anti").join(other, on, how)
    return met.unionByName(rest)
