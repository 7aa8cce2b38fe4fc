"""The event history as a stream: the same aggregates, kept up as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources.store import Scratch


def events(spark: SparkSession, folder: str, names: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of events, by a pattern of their names, as they appear in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def versions(stream: DataFrame, entity: str, ts: str) -> DataFrame:
    """Versions, first and last edit of each entity; state is one small row for each entity."""
    return stream.groupBy(entity).agg(F.count(F.lit(1)).alias("versions"), F.min(ts).alias("first_edit"), F.max(ts).alias("last_edit"))


def daily(stream: DataFrame, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    """Events of each kind by day; days are closed and dropped from the state once the watermark has passed them."""
    rows = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.window("_t", "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("day_start"), kind, "n")


def run_available(stream: DataFrame, scratch: Scratch, name: str, keys: list[str]) -> DataFrame:
    """Run a stream over all that is there, in update mode; returns the latest row of each key.

    Each batch is written under its number, so one that is run again after a failure
    replaces what it had written.
    """
    path = scratch.path(name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch.path(f"{name}-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = scratch.spark.read.option("basePath", path).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
