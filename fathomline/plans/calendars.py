"""Queries on dated schedules, holidays and conditional tags, at the times of orders and along edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import calendar, conditional
from fathomline.operators import graph, near
from fathomline.plans.graphs import EDGES, _origins, edges
from fathomline.plans.registry import query, table
from fathomline.sources.store import Scratch

#: Schedules by the order's key: a week, a range over a year's end with a closed day in it, seasons with holidays, a night, two that cannot be read.
TEXTS = [
    "Mo-Fr 08:00-18:00; Sa 09:00-13:00",
    "1996 Dec 20 - 1997 Jan 05; Mo 10:00-11:00; Dec 25",
    "Jun-Aug: Mo-Sa,PH 07:45-21:30; Sep-May Mo-Fr 09:00-17:00",
    "Sa-Su 22:00-02:00; Jan 1 off",
    "24/7; Dec 26",
    "Mo-Fr sunrise-sunset",
    "1997 Jan 05 - 1996 Dec 20",
]
#: Holidays: days of orders whose day of the year is 1 or a multiple of 50.
_HOLIDAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE dayofyear(o_orderdate) = 1 OR dayofyear(o_orderdate) % 50 = 0)"


def _orders(spark, sf_dir) -> DataFrame:
    """Each order with a schedule and a minute of its day."""
    o = table(spark, sf_dir, "orders")
    text = F.get(F.array(*map(F.lit, TEXTS)), (F.col("o_orderkey") % len(TEXTS)).cast("int"))
    minute = (F.col("o_orderkey") * 37 + F.col("o_custkey") * 11) % 1440
    return o.select(F.col("o_orderkey").alias("id"), text.alias("text"), F.timestamp_add("MINUTE", minute, F.to_date("o_orderdate").cast("timestamp")).alias("moment"))


def _holidays(spark, sf_dir) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").where((F.dayofyear("o_orderdate") == 1) | (F.dayofyear("o_orderdate") % 50 == 0)).select(day.alias("day")).distinct()


_MOMENTS = f"(SELECT o_orderkey AS id, o_orderkey % {len(TEXTS)} AS k, CAST(o_orderdate AS DATE) AS day, (o_orderkey * 37 + o_custkey * 11) % 1440 AS m FROM orders)"
# what each schedule says of a day x (day, wd from 0, md = month * 100 + day, mo, h: holiday): its open minutes from a to b
_OPEN = """(SELECT x.*, unnest(CASE k
    WHEN 0 THEN CASE WHEN wd < 5 THEN [[480, 1080]] WHEN wd = 5 THEN [[540, 780]] ELSE [] END
    WHEN 1 THEN CASE WHEN md = 1225 THEN [] WHEN day BETWEEN DATE '1996-12-20' AND DATE '1997-01-05' THEN CASE WHEN wd = 0 THEN [[0, 1440], [600, 660]] ELSE [[0, 1440]] END WHEN wd = 0 THEN [[600, 660]] ELSE [] END
    WHEN 2 THEN CASE WHEN mo BETWEEN 6 AND 8 THEN CASE WHEN wd < 6 OR h THEN [[465, 1290]] ELSE [] END WHEN wd < 5 THEN [[540, 1020]] ELSE [] END
    WHEN 3 THEN CASE WHEN md = 101 THEN [] WHEN wd = 5 THEN [[1320, 1440]] WHEN wd = 6 THEN [[0, 120], [1320, 1440]] WHEN wd = 0 THEN [[0, 120]] ELSE [] END
    WHEN 4 THEN CASE WHEN md = 1226 THEN [] ELSE [[0, 1440]] END ELSE [] END) AS span FROM x)"""
_DAYS = "SELECT k, d AS day, isodow(d) - 1 AS wd, month(d) * 100 + day(d) AS md, month(d) AS mo, d IN (SELECT day FROM holidays) AS h"


@query(
    f"""WITH holidays AS {_HOLIDAYS}, x AS ({_DAYS}, id, m FROM (SELECT *, day AS d FROM {_MOMENTS})), o AS {_OPEN}
    SELECT p.id, p.k < 5 AS supported, coalesce(bool_or(p.m >= o.span[1] AND p.m < o.span[2]), false) AS active FROM x p LEFT JOIN o ON o.id = p.id GROUP BY p.id, p.k"""
)
def dated_hours(spark, sf_dir):
    """Whether schedules with dates, seasons and holidays hold at the moments of orders."""
    rows = calendar.with_holidays(_orders(spark, sf_dir), "moment", _holidays(spark, sf_dir), "holiday")
    rows = calendar.with_schedule(rows, "text", "s")
    return rows.select("id", "s.supported", calendar.active(F.col("s"), F.col("moment"), F.col("holiday")).alias("active"))


@query(
    f"""WITH holidays AS {_HOLIDAYS}, x AS ({_DAYS} FROM (SELECT k, d FROM (SELECT DISTINCT k FROM {_MOMENTS}) CROSS JOIN (SELECT unnest(generate_series((SELECT min(day) FROM {_MOMENTS}), (SELECT max(day) FROM {_MOMENTS}) + INTERVAL 800 DAY, INTERVAL 1 DAY))::DATE AS d))), o AS MATERIALIZED {_OPEN},
    n AS (SELECT p.id, min(CASE WHEN o.day = p.day AND p.m >= o.span[1] AND p.m < o.span[2] THEN p.m WHEN o.day > p.day OR o.span[1] > p.m THEN (o.day - p.day) * 1440 + o.span[1] END) AS at FROM {_MOMENTS} p JOIN o ON o.k = p.k AND o.day BETWEEN p.day AND p.day + 8 OR o.k = p.k AND p.k = 1 AND o.day BETWEEN p.day AND p.day + 731 GROUP BY p.id)
    SELECT p.id, p.day::TIMESTAMP + to_minutes(CAST(n.at AS BIGINT)) AS next_active FROM {_MOMENTS} p LEFT JOIN n USING (id)"""
)
def next_dated(spark, sf_dir):
    """The moment of each order if its schedule holds then, else the next start, holidays looked at."""
    return calendar.next_active(_orders(spark, sf_dir), "text", "moment", _holidays(spark, sf_dir)).select("id", "next_active")


@query("SELECT count(DISTINCT day) AS dates, min(day)::VARCHAR AS first, max(day)::VARCHAR AS last, count(*) - count(DISTINCT day) AS repeated, (SELECT count(*) FROM orders WHERE o_orderkey % 9 = 0) AS invalid FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 9 <> 0)")
def holiday_contract(spark, sf_dir):
    """Check of dates as texts, those of every ninth order written with slashes."""
    o = table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    got = calendar.holiday_contract(o.select(F.when(F.col("o_orderkey") % 9 == 0, F.replace(text, F.lit("-"), F.lit("/"))).otherwise(text).alias("day")))
    return got.withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


# texts of edges by their cents
ACCESS = ["", "no @ (Mo-Fr 07:00-09:00)", "delivery @ (Mo-Sa 07:00-11:00); yes @ (Mo-Sa 18:30-24:00)", "no @ (weight > 7.5 t)", 'no @ ("rush; hour")', "yes @ (2026 Dec 20 - 2027 Jan 05); no @ (PH,Mo-Tu 10:00-12:00)", "psv @ (06:00-10:00)"]
SPEED = ["", "30 @ (Mo-Fr 07:00-17:00); 50 @ (22:00-06:00)", "none @ (Sa-Su 00:00-24:00)", "20 @ (wet)"]
ONEWAY = ["", "Mo-Fr 08:00-10:00", "no @ (20:00-06:00)", "yes @ (Mo-Su 00:00-24:00); no @ (PH 00:00-24:00)"]
START, LORRY = "2026-12-21 05:00:00", {"vehicle": "delivery", "weight": 12.0}
#: Days within the two weeks of the searches.
DAYS_OFF = ("2026-12-25", "2026-12-26", "2027-01-01")


#: Days from START on in which rules name dates: behind them only days of the week do, so a week is like the next.
DATED = 17


def _texts(e: DataFrame) -> DataFrame:
    pick = lambda texts: F.get(F.array(*map(F.lit, texts)), (F.col("cents") % len(texts)).cast("int"))
    return e.select("id", "u", "v", "w", "cents", pick(ACCESS).alias("access"), pick(SPEED).alias("speed"), pick(ONEWAY).alias("oneway"))


def _tagged(spark, sf_dir) -> DataFrame:
    """Edges with the rules of their texts."""
    return _with_rules(_texts(edges(spark, sf_dir)))


def _with_rules(e: DataFrame) -> DataFrame:
    for name, read in (("access", conditional.access), ("speed", conditional.speeds), ("oneway", conditional.oneways)):
        e = conditional.attach(e, name, read(e, name), f"{name}_rules")
    return e


def _dates() -> F.Column:
    return F.array(*(F.lit(d).cast("date") for d in DAYS_OFF))


_SQL_TIMES = f"(SELECT *, isodow(t) - 1 AS wd, hour(t) * 60 + minute(t) AS mi, t::DATE IN ({', '.join(f'DATE {d!r}' for d in DAYS_OFF)}) AS h FROM (SELECT id, cents, TIMESTAMP '{START}' + to_minutes(cents % 20160) AS t FROM {EDGES}))"


@query(
    f"""SELECT id, CASE cents % 7 WHEN 0 THEN true WHEN 1 THEN NOT (wd < 5 AND mi >= 420 AND mi < 540) WHEN 2 THEN wd < 6 AND (mi >= 420 AND mi < 660 OR mi >= 1110) WHEN 3 THEN false WHEN 4 THEN false
    WHEN 5 THEN t::DATE BETWEEN DATE '2026-12-20' AND DATE '2027-01-05' AND NOT ((h OR wd < 2) AND mi >= 600 AND mi < 720) ELSE NOT (mi >= 360 AND mi < 600) END AS open,
    CASE cents % 4 WHEN 1 THEN least(80.0::DOUBLE, CASE WHEN wd < 5 AND mi >= 420 AND mi < 1020 THEN 30.0 END, CASE WHEN mi >= 1320 OR mi < 360 THEN 50.0 END) ELSE 80.0::DOUBLE END AS kmh,
    CASE cents % 4 WHEN 1 THEN CASE WHEN wd < 5 AND mi >= 480 AND mi < 600 THEN 'yes' ELSE 'base' END WHEN 2 THEN CASE WHEN mi >= 1200 OR mi < 360 THEN 'no' ELSE 'base' END WHEN 3 THEN CASE WHEN h THEN 'no' ELSE 'yes' END ELSE 'base' END AS direction FROM {_SQL_TIMES}"""
)
def conditional_tags(spark, sf_dir):
    """Access, speed and direction of a 12-tonne delivery vehicle from the texts of conditional tags, at a moment for each edge."""
    at = F.timestamp_add("MINUTE", F.col("cents") % 20160, F.lit(START).cast("timestamp"))
    e = _tagged(spark, sf_dir).withColumn("at", at)
    return e.select(
        "id",
        conditional.may_pass(F.col("access_rules"), F.col("at"), _dates(), **LORRY).alias("open"),
        conditional.speed_at(F.lit(80.0), F.col("speed_rules"), F.col("at"), _dates()).alias("kmh"),
        conditional.oneway_at(F.lit("base"), F.col("oneway_rules"), F.col("at"), _dates()).alias("direction"),
    )


@query()
def tagged_paths(spark, sf_dir):
    """Earliest arrivals where access, speed and direction follow from the texts at the arrival at an edge; edges against their direction may be taken while a rule says no to one-way. Tested against a plain search."""
    at = F.timestamp_add("SECOND", F.floor("cost"), F.lit(START).cast("timestamp"))
    may, way = conditional.may_pass(F.col("access_rules"), at, _dates(), **LORRY), conditional.oneway_at(F.lit("yes"), F.col("oneway_rules"), at, _dates())
    passes = may & (~F.col("against") | (way == "no"))
    kmh = conditional.speed_at(F.lit(80.0), F.col("speed_rules"), at, _dates())

    def both_ways(e: DataFrame, *columns: str) -> DataFrame:
        ruled = ("access_rules", "speed_rules", "oneway_rules")
        back = e.where(F.size("oneway_rules.rules") > 0).select(*(F.col({"u": "v", "v": "u"}.get(c, c)).alias(c) for c in columns), *ruled, F.lit(True).alias("against"))
        return e.select(*columns, *ruled, F.lit(False).alias("against")).unionByName(back)

    # the texts that there are, their rules looked up at every minute of DATED and of one week behind it
    texts = ["access", "speed", "oneway"]
    plain = _texts(edges(spark, sf_dir)).select("u", "v", (F.col("w") * 60).alias("w"), *texts)
    scratch = Scratch(spark, "kinds")
    ruled = scratch.save(_with_rules(plain.select(*texts).distinct()), "texts")
    kinds = both_ways(ruled, *texts).select(*texts, "against").distinct()
    kinds = scratch.save(kinds.withColumn("kind", F.row_number().over(Window.orderBy(*texts, "against")) - 1), "kinds")  # a few texts
    slots = spark.range((DATED + 7) * 1440).repartition(spark.sparkContext.defaultParallelism).select(F.col("id").alias("slot"), (F.col("id") * 60.0).alias("cost"))
    each = lambda name, value: slots.crossJoin(F.broadcast(ruled.dropDuplicates([name]).select(name, f"{name}_rules"))).select("slot", name, value)
    found = scratch.save(each("access", may.alias("may")), "access"), scratch.save(each("speed", kmh.alias("kmh")), "speed"), scratch.save(each("oneway", (way == "no").alias("free")), "oneway")
    speeds = F.broadcast(kinds)
    for name, got in zip(texts, found):
        speeds = speeds.join(got, name) if name == "access" else speeds.join(F.broadcast(got), ["slot", name])
    speeds = speeds.select("kind", "slot", F.when(F.col("may") & (~F.col("against") | F.col("free")), F.col("kmh")).alias("speed"))
    kind = F.broadcast(kinds)
    packed = plain.withColumn("against", F.lit(False)).unionByName(plain.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", *texts, F.lit(True).alias("against"))).join(kind, [*texts, "against"]).select("u", "v", "w", "kind")
    got = near.arrivals(packed, _origins(spark, sf_dir), Scratch(spark, "timed"), speeds, 60.0, DATED * 1440, 7 * 1440, lambda t, w, kmh: t + np.ceil(w * 80 / kmh), 60.0)
    if got is None:
        e = both_ways(_tagged(spark, sf_dir).withColumn("seconds", F.col("w") * 60), "u", "v", "seconds")
        got = graph.shortest(e, _origins(spark, sf_dir), Scratch(spark, "tagged"), step=lambda t: t + F.ceil(F.col("seconds") * 80 / kmh), passes=passes, least=60.0, ahead=True)
    return got.select("origin", "node", F.col("cost").alias("arrival"))
