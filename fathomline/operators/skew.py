"""Joins on keys of which a few may have very many rows on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is cut into parts of so many; the most frequent HOT_KEYS keys may be. Of n rows any
#: other key has n / HOT_KEYS at most, so a task's share falls with the number of keys that are cut.
HOT_ROWS, HOT_KEYS, MOST_PARTS = 50_000, 10_000, 4_096


def salted(many: DataFrame, few: DataFrame, on: list[str], salt: Column, how: str = "inner", kept: tuple[str, ...] = ()) -> DataFrame:
    """many joined with few on the columns on (numbers or short texts), however many rows of ``many`` have one key.

    The rows of a frequent key are cut into parts by the hash of salt, and the rows of
    ``few`` repeated for each part. The frequent keys, at most HOT_KEYS rows, go to
    all executors. how is inner or left. A null key meets nothing.
    """
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS)
    parts = F.least(F.ceil(F.col("_n") / F.lit(HOT_ROWS)), F.lit(MOST_PARTS)).cast("int")
    hot = F.broadcast(counts.orderBy(F.desc("_n"), *on).limit(HOT_KEYS).select(*on, parts.alias("_parts")))
    cut = many.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(F.hash(salt), F.col("_parts")), F.lit(0))).drop("_parts")
    spread = few.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return cut.join(spread, [*on, "_part"], how).drop("_part", *kept)
