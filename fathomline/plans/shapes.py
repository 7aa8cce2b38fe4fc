"""Footprints made from embeddings: star-shaped rings, a corner for each of the first twelve dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import geo, polygons, signals
from fathomline.plans.registry import query, table

CORNERS = 12


def rings(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    radius = F.transform(F.slice("embedding", 1, CORNERS), lambda v: F.round(10 + 20 * F.abs(v.cast("double")), 3))
    x = F.transform(radius, lambda r, i: r * F.cos(i * 2 * 3.141592653589793 / CORNERS))
    y = F.transform(radius, lambda r, i: r * F.sin(i * 2 * 3.141592653589793 / CORNERS))
    return e.select(F.col("vec_id").alias("id"), "label", x.alias("xs"), y.alias("ys"))


_R = "(SELECT vec_id AS id, label, list_transform(range(1, 13), lambda i: round(10 + 20 * abs(embedding[i]::DOUBLE), 3)) AS r FROM embeddings)"
_XY = f"(SELECT id, label, list_transform(range(1, 13), lambda i: r[i] * cos((i - 1) * 2 * 3.141592653589793 / 12)) AS x, list_transform(range(1, 13), lambda i: r[i] * sin((i - 1) * 2 * 3.141592653589793 / 12)) AS y FROM {_R})"


@query(
    f"""SELECT id, round(list_sum(list_transform(range(1, 13), lambda i: x[i] * y[i % 12 + 1] - x[i % 12 + 1] * y[i])) / 2, 4) AS area, round(list_sum(list_transform(range(1, 13), lambda i: sqrt(pow(x[i % 12 + 1] - x[i], 2) + pow(y[i % 12 + 1] - y[i], 2)))), 4) AS perimeter FROM {_XY}"""
)
def ring_metrics(spark, sf_dir):
    """Area and perimeter by array functions alone."""
    close = lambda c: F.concat(c, F.array(F.get(c, F.lit(0))))
    r = rings(spark, sf_dir).select("id", close(F.col("xs")).alias("x"), close(F.col("ys")).alias("y"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(CORNERS - 1)), lambda i: F.hypot(F.get("x", i + 1) - F.get("x", i), F.get("y", i + 1) - F.get("y", i)))
    return r.select("id", F.round(geo.ring_area(F.col("x"), F.col("y")), 4).alias("area"), F.round(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v), 4).alias("perimeter"))


def shapes(spark, sf_dir) -> DataFrame:
    """Rings, of which every second has a hole of three tenths its width, and every third a part of half its width beside it."""
    r = rings(spark, sf_dir)
    scaled = lambda c, by, shift: F.transform(c, lambda v: v * by + shift)
    none = F.array().cast("array<double>")
    hole, part = F.col("id") % 2 == 0, F.col("id") % 3 == 0
    made = {c: F.concat(c, F.when(hole, scaled(F.col(c), 0.3, 0.0)).otherwise(none), F.when(part, scaled(F.col(c), 0.5, shift)).otherwise(none)) for c, shift in (("xs", 1000.0), ("ys", 0.0))}
    count = 1 + hole.cast("int") + part.cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * CORNERS)
    kinds = F.concat(F.array(F.lit(True)), F.when(hole, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")), F.when(part, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    return r.select("id", made["xs"].alias("xs"), made["ys"].alias("ys"), starts.alias("starts"), kinds.alias("outer"))


@query()
def shape_descriptors(spark, sf_dir):
    """All descriptors, flags and the score; kernels are tested against closed forms."""
    # the array keeps the kernel in one place: a filter on its result would have it evaluated twice
    rows = rings(spark, sf_dir).select("id", F.explode(F.array(polygons.descriptors("xs", "ys"))).alias("d")).where("d.valid").select("id", "d.*")
    angle = lambda degrees: F.exists("angles", lambda a: signals.near(a, degrees))
    shape = {c: F.col(c) for c in ("aspect", "reflect", "rot180", "rot90", "rot60", "rot45", "rot72", "circularity", "convexity", "vertices", "right_fraction")}
    shape |= {"length_m": F.col("length"), "width_m": F.col("width"), "area_m2": F.col("area"), "golden_angle": F.exists("angles", signals.golden_angle), "has_108": angle(108), "has_120": angle(120)}
    return rows.withColumn("flags", signals.flags(shape)).withColumn("score", signals.score(shape)).drop("angles")


_SIZES = "(SELECT id, list_sum(list_transform(range(1, 13), lambda i: x[i] * y[i % 12 + 1] - x[i % 12 + 1] * y[i])) / 2 AS a, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS h, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS p FROM " + _XY + ")"


@query(f"SELECT id, 'valid' AS status, 1 + p AS parts, h AS holes, round(a * (1 - 0.09::DOUBLE * h + 0.25::DOUBLE * p), 4) AS area, round(0.09::DOUBLE * h / (1 + 0.25::DOUBLE * p), 6) AS hole_fraction, round(12 / sqrt(a * (1 - 0.09::DOUBLE * h + 0.25::DOUBLE * p)), 6) AS vertex_density FROM {_SIZES}")
def polygon_quality(spark, sf_dir):
    """Status, parts, holes and sizes of shapes of several rings."""
    d = shapes(spark, sf_dir).select("id", F.explode(F.array(polygons.descriptors("xs", "ys", "starts", "outer"))).alias("d"))
    return d.select("id", "d.status", "d.parts", "d.holes", F.round("d.area", 4).alias("area"), F.round("d.hole_fraction", 6).alias("hole_fraction"), F.round("d.vertex_density", 6).alias("vertex_density"))


_A = """(SELECT id, list_transform(range(1, 13), lambda i: round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((x[(i + 10) % 12 + 1] - x[i]) * (x[i % 12 + 1] - x[i]) + (y[(i + 10) % 12 + 1] - y[i]) * (y[i % 12 + 1] - y[i]))
    / (sqrt(pow(x[(i + 10) % 12 + 1] - x[i], 2) + pow(y[(i + 10) % 12 + 1] - y[i], 2)) * sqrt(pow(x[i % 12 + 1] - x[i], 2) + pow(y[i % 12 + 1] - y[i], 2))))))), 6)) AS angles FROM """ + _XY + ")"


def _angles(spark, sf_dir) -> DataFrame:
    """Corner angles in millionths of a degree, so that engines agree on the bin of each."""
    return rings(spark, sf_dir).select("id", F.transform(polygons.corner_angles(F.col("xs"), F.col("ys")), lambda a: F.round(a, 6)).alias("angles"))


@query(f"SELECT CAST(floor(a) AS BIGINT) AS degree, count(*) AS n FROM (SELECT unnest(angles) AS a FROM {_A}) GROUP BY 1")
def angle_histogram(spark, sf_dir):
    """Corners by whole degree."""
    rows = _angles(spark, sf_dir).select(F.explode("angles").alias("a"))
    return rows.groupBy(F.floor("a").alias("degree")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, list_sort(list_transform(list_filter(angles, lambda a: a BETWEEN 134.5 AND 140.5), lambda a: {{'off': round(abs(a - 137.50776405003785), 6), 'a': a}}))[1].a AS angle FROM {_A}")
def closest_golden_angle(spark, sf_dir):
    return _angles(spark, sf_dir).select("id", geo.closest_in_band(F.col("angles"), 134.5, 140.5).alias("angle"))
