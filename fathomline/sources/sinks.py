"""Sinks: plain tables, JSON lines without non-finite numbers, and GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(rows: DataFrame) -> DataFrame:
    """Null for NaN and infinities in number columns, which JSON cannot hold."""
    bad = {f.name: F.when(F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf")), None).otherwise(F.col(f.name)) for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return rows.withColumns(bad) if bad else rows


def write(rows: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """Write parquet (zstd), orc, csv with header, or json lines; the committer makes a job's files visible at once."""
    writer = finite(rows).write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    else:
        writer.format(kind).save(path)


def feature(geometry: Column, properties: list[str], kind: str = "Polygon") -> Column:
    """A GeoJSON feature as text; geometry: array of rings (or what the kind takes)."""
    props = F.struct(*properties)
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), geometry.alias("coordinates")).alias("geometry"), props.alias("properties")))


def write_features(rows: DataFrame, feature_column: str, path: str) -> None:
    """One feature a line, in as many files as there are partitions."""
    rows.select(feature_column).write.text(path)


def bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by key, so that later joins on it need no shuffle."""
    rows.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
