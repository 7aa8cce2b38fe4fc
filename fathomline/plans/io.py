"""Round trips through formats, exports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import quality
from fathomline.plans.registry import query, table
from fathomline.plans.shapes import rings
from fathomline.sources import files, sinks
from fathomline.sources.store import Scratch
from fathomline.streaming import history

_H = "sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment))"


@query(
    f"""SELECT f.format, d.n, d.low, d.high FROM (VALUES ('parquet'), ('orc'), ('csv'), ('json')) f(format) CROSS JOIN (SELECT count(*) AS n, CAST(sum(('0x' || substr(h, 1, 12))::BIGINT) AS VARCHAR) AS low, CAST(sum(('0x' || substr(h, 13, 12))::BIGINT) AS VARCHAR) AS high FROM (SELECT {_H} AS h FROM customer)) d"""
)
def parity_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written in each format and read again have one digest."""
    scratch, columns = Scratch(spark, "parity"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    rows = table(spark, sf_dir, "customer").select(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = None
    for kind in files.FORMATS:
        sinks.write(rows, scratch.path(kind), kind)
        one = quality.digest(files.table(spark, scratch.path(kind), kind, schema), columns).withColumn("format", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'json' AS backend, 1 AS errors, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def backend_fallback(spark, sf_dir):
    """The preferred format is not there, so the next one is read."""
    scratch = Scratch(spark, "backends")
    sinks.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), scratch.path("json"), "json")
    rows, kind, errors = files.first_readable(spark, {"parquet": scratch.path("nothing"), "json": scratch.path("json")}, "o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"), F.countDistinct("o_orderpriority").alias("priorities"))
    return counts.select(F.lit(kind).alias("backend"), F.lit(len(errors)).alias("errors"), "n", "keys", "priorities")


@query("SELECT vec_id AS id, 12 AS corners, 'Polygon' AS kind, label FROM embeddings")
def geojson_export(spark, sf_dir):
    """Rings exported as features, a line each, and read back."""
    scratch = Scratch(spark, "geojson")
    ring = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))
    pairs = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    made = rings(spark, sf_dir).select("id", "label", F.array(F.concat(pairs, F.slice(pairs, 1, 1))).alias("g"))
    sinks.write_features(made.select(sinks.feature(F.col("g"), ["id", "label"]).alias("f")), "f", scratch.path("features"))
    back = files.lines(spark, scratch.path("features"), "geometry STRING, properties STRUCT<id: BIGINT, label: INT>")
    outer = files.rings(F.col("geometry"))
    return back.select("properties.id", (F.size(outer) - 1).alias("corners"), F.get_json_object("geometry", "$.type").alias("kind"), "properties.label")


@query("SELECT user_id, count(*) AS versions, min(ts) AS first_edit, max(ts) AS last_edit FROM events GROUP BY user_id")
def streamed_history(spark, sf_dir):
    """The entity history kept up by a stream over the events."""
    schema = table(spark, sf_dir, "events").schema
    stream = history.versions(history.events(spark, sf_dir, "events.parquet", schema), "user_id", "ts")
    return history.run_available(stream, Scratch(spark, "stream"), "versions", ["user_id"])


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_days(spark, sf_dir):
    """Daily windows of a stream with a watermark."""
    schema = table(spark, sf_dir, "events").schema
    stream = history.daily(history.events(spark, sf_dir, "events.parquet", schema), "ts", "event_type")
    return history.run_available(stream, Scratch(spark, "stream"), "days", ["day_start", "event_type"])
