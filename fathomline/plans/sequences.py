"""Ordered rows: turns of a conversation as stops of a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import geo
from fathomline.plans.registry import query, table

_STEP = "(SELECT conv_id, turn, role, length(text) AS len FROM conversations)"
def _way():
    return Window.partitionBy("conv_id").orderBy("turn")



def _steps(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("len"))


@query(f"SELECT conv_id, turn AS u, next_turn AS v, len FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM {_STEP}) WHERE next_turn IS NOT NULL")
def lead_segments(spark, sf_dir):
    return _steps(spark, sf_dir).withColumn("v", F.lead("turn").over(_way())).where("v IS NOT NULL").select("conv_id", F.col("turn").alias("u"), "v", "len")


@query(f"SELECT conv_id, turn, CAST(sum(len) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS distance, CAST(coalesce(sum(len) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts_at FROM {_STEP}")
def cumulative_route(spark, sf_dir):
    upto = _way().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = _way().rowsBetween(Window.unboundedPreceding, -1)
    return _steps(spark, sf_dir).select("conv_id", "turn", F.sum("len").over(upto).alias("distance"), F.coalesce(F.sum("len").over(before), F.lit(0)).alias("starts_at"))


@query(
    f"""SELECT conv_id, island, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, CAST(sum(len) AS BIGINT) AS total FROM (
    SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, CASE WHEN (len > 300) = lag(len > 300) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS change FROM {_STEP})) GROUP BY conv_id, island"""
)
def maneuver_islands(spark, sf_dir):
    """Runs of steps in the same state: gaps and islands."""
    state = F.col("len") > 300
    rows = _steps(spark, sf_dir).withColumn("change", F.when(state == F.lag(state).over(_way()), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("change").over(_way().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"))


@query(
    f"""SELECT conv_id, turn, angle, CASE WHEN abs(angle) < 15 THEN 'straight' ELSE (CASE WHEN abs(angle) < 45 THEN 'slight' WHEN abs(angle) < 135 THEN 'turn' ELSE 'sharp' END) || (CASE WHEN angle > 0 THEN '-right' ELSE '-left' END) END AS maneuver FROM (
    SELECT conv_id, turn, CASE WHEN d > 180 THEN d - 360 ELSE d END AS angle FROM (SELECT conv_id, turn, ((len % 360 - lag(len % 360) OVER (PARTITION BY conv_id ORDER BY turn)) % 360 + 360) % 360 AS d FROM {_STEP})) WHERE angle IS NOT NULL"""
)
def maneuvers(spark, sf_dir):
    heading = F.col("len") % 360
    rows = _steps(spark, sf_dir).withColumn("angle", geo.turn(F.lag(heading).over(_way()).cast("double"), heading.cast("double")).cast("long"))
    return rows.where("angle IS NOT NULL").select("conv_id", "turn", "angle", geo.maneuver(F.col("angle")).alias("maneuver"))


@query(f"SELECT conv_id, role, len, len - first_value(len) OVER (PARTITION BY conv_id ORDER BY turn) AS delta FROM {_STEP}")
def profile_deltas(spark, sf_dir):
    """Difference of each alternative from the first one."""
    return _steps(spark, sf_dir).select("conv_id", "role", "len", (F.col("len") - F.first("len").over(_way())).alias("delta"))


@query("SELECT event_id, date_trunc('day', ts) AS day, dayofweek(ts) IN (1, 2, 3, 4, 5) AND hour(ts) BETWEEN 8 AND 17 OR (dayofweek(ts) = 6 AND (hour(ts) >= 22)) OR (dayofweek(ts) = 0 AND hour(ts) < 4) AS active FROM events")
def active_window(spark, sf_dir):
    """Weekly windows, one over midnight: minutes of the week against an array of intervals."""
    windows = [(d * 1440 + 480, d * 1440 + 1080) for d in range(5)] + [(5 * 1440 + 1320, 6 * 1440 + 240)]
    spans = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in windows))
    minute = F.weekday("ts") * 1440 + F.hour("ts") * 60 + F.minute("ts")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_trunc("day", "ts").alias("day"), F.exists(spans, lambda w: (minute >= w["a"]) & (minute < w["b"])).alias("active"))


@query("SELECT event_id, ts + INTERVAL 1 SECOND * CAST(round(value) AS BIGINT) AS arrival FROM events")
def arrival_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.timestamp_add("SECOND", F.round("value").cast("int"), F.col("ts")).alias("arrival"))


@query("SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def daily_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("SELECT e.event_id, p.event_id AS previous_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts > p.ts")
def next_active(spark, sf_dir):
    """As-of: the last view of the same user before each event, by a running maximum over one sort."""
    e = table(spark, sf_dir, "events")
    mark = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    before = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    return e.withColumn("_m", mark).withColumn("previous_id", F.max("_m").over(before)["event_id"]).select("event_id", "previous_id")
