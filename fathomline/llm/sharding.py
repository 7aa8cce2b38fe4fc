"""Sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone: no ring
table, and one shard more takes rows only into itself, 1/(n+1) of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows are numbered within blocks of so many neighbouring keys and of texts' checksums.
KEY_BITS, SALTS = 20, 16
#: Keys that are no integers are numbered within 2^12 ranges of their hash.
HASH_BITS = 12


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: jump ahead from shard to shard until past the last."""
    key = keys.astype(np.uint64)
    at, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    moving = np.arange(len(key))
    while len(moving):
        at[moving] = ahead[moving]
        k = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        key[moving] = k
        ahead[moving] = ((at[moving] + 1) * (2.0**31 / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return at


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 1 and text_crc32 its checksum; a null
    text counts as one of no bytes (1, 0). A null key is a key like any other, and
    keys may be of any type. slot numbers the rows of a shard from 0 without gaps, in
    order of key range (of its hash, if the key is no integer) and checksum. Rows of one key go to one shard, repeated rows included; their
    slots differ. grown_shard is the shard if there were one more. An empty table
    gives an empty result. Other columns of docs are not read.

    Only the small columns are shuffled: rows are numbered within a block of
    2^20 neighbouring keys (cut again by checksum, as one key may have many
    rows), and blocks are placed one after another by a running sum of counts.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("struct<shard:int,grown_shard:int>")
    def place(hashes: pd.Series) -> pd.DataFrame:
        h = hashes.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump(h, shards).astype(np.int32), "grown_shard": jump(h, shards + 1).astype(np.int32)})

    whole = docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    near = F.shiftright(F.col(key).cast("long"), KEY_BITS) if whole else F.shiftrightunsigned(F.xxhash64(key), 64 - HASH_BITS)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    ).withColumn("_at", place(F.xxhash64(F.col(key))))
    rows = rows.select(
        key,
        "size",
        "text_crc32",
        F.col("_at.shard").alias("shard"),
        F.col("_at.grown_shard").alias("grown_shard"),
        near.alias("_range"),
        (F.col("text_crc32") % SALTS).alias("_salt"),
    )
    block = ["shard", "_range", "_salt"]
    before = Window.partitionBy("shard").orderBy("_range", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*block)
        .count()
        .select("shard", *(F.col(c).alias(f"{c}_") for c in block[1:]), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
        .withColumnRenamed("shard", "shard_")
    )
    inside = F.row_number().over(Window.partitionBy(*block).orderBy(key, "text_crc32", "size"))
    numbered = rows.withColumn("_inside", inside)
    same = F.lit(True)
    for c in block:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return numbered.join(offsets, same).select(
        key,
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_before") + F.col("_inside") - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write docs with all its columns under path, a folder shard=N for each shard; a column shard of docs is replaced."""

    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    docs.drop("shard").withColumn("shard", place(F.xxhash64(F.col(key)))).write.partitionBy("shard").parquet(path)
