"""Queries on points: the first two dimensions of the embeddings, in thousandths, and boxes around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import geo, signals, stats
from fathomline.operators import neighbours, sample, spatial
from fathomline.plans.registry import query, table
from fathomline.sources.store import Scratch


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole thousandths, so that squared distances are exact in any engine."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.round(F.col("embedding")[0].cast("double") * 1000).alias("x"),
        F.round(F.col("embedding")[1].cast("double") * 1000).alias("y"),
        F.round(F.abs(F.col("embedding")[2].cast("double")) * 1000 + 1).alias("area"),
        "label",
    )


POINTS = """(SELECT vec_id AS id, round(embedding[1]::DOUBLE * 1000) AS x, round(embedding[2]::DOUBLE * 1000) AS y, round(abs(embedding[3]::DOUBLE) * 1000 + 1) AS area, label FROM embeddings)"""


def boxes(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir)
    half = F.col("area") % 40 + 5
    return p.select("id", (F.col("x") - half).alias("x0"), (F.col("y") - half).alias("y0"), (F.col("x") + half + 7).alias("x1"), (F.col("y") + half).alias("y1"), F.col("id").alias("seq"))


BOXES = f"(SELECT id, x - (area % 40 + 5) AS x0, y - (area % 40 + 5) AS y0, x + (area % 40 + 5) + 7 AS x1, y + (area % 40 + 5) AS y1, id AS seq FROM {POINTS})"
_OTHER = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2)"


def _near(p: DataFrame, k: int) -> DataFrame:
    """The k nearest others of each point within 60."""
    return spatial.nearest_within(p, 60.0, k, Scratch(p.sparkSession, "near"))


@query(f"SELECT id, id2, d2, rank FROM (SELECT a.id, b.id AS id2, {_OTHER} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_OTHER}, b.id) AS rank FROM {POINTS} a JOIN {POINTS} b ON a.id <> b.id AND {_OTHER} <= 60 * 60) WHERE rank <= 4")
def bounded_neighbours(spark, sf_dir):
    p = points(spark, sf_dir)
    return _near(p, 4).select("id", "id2", "d2", "rank")


@query(f"SELECT id, id2, d2 FROM (SELECT a.id, b.id AS id2, {_OTHER} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_OTHER}, b.id) AS rank FROM {POINTS} a JOIN {POINTS} b ON b.label = 1 AND a.label <> 1) WHERE rank = 1")
def nearest_control(spark, sf_dir):
    p = points(spark, sf_dir)
    return neighbours.k_nearest(p.where("label <> 1"), p.where("label = 1"), 1, Scratch(spark, "nearest")).select("id", "id2", "d2")


_NN = f"(SELECT id, id2 FROM (SELECT a.id, b.id AS id2, row_number() OVER (PARTITION BY a.id ORDER BY {_OTHER}, b.id) AS rank FROM {POINTS} a JOIN {POINTS} b ON a.id <> b.id AND {_OTHER} <= 60 * 60) WHERE rank <= 2)"


@query(f"SELECT DISTINCT least(id, id2) AS id, greatest(id, id2) AS id2 FROM {_NN}")
def neighbour_edges(spark, sf_dir):
    p = points(spark, sf_dir)
    pairs = _near(p, 2)
    return spatial.unordered(pairs, "id", "id2")


@query(f"WITH n AS (SELECT * FROM (SELECT a.id, b.id AS id2, row_number() OVER (PARTITION BY a.id ORDER BY {_OTHER}, b.id) AS rank FROM {POINTS} a JOIN {POINTS} b ON a.id <> b.id AND {_OTHER} <= 60 * 60) WHERE rank = 1) SELECT x.id AS a, x.id2 AS b, y.id2 AS c FROM n x JOIN n y ON x.id2 = y.id WHERE y.id2 <> x.id")
def neighbour_chain(spark, sf_dir):
    p = points(spark, sf_dir)
    first = _near(p, 1).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    return first.join(first.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").where("a <> c").select("a", "b", "c")


@query(
    f"""SELECT id, pid, mode, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mode, d2, pid) AS rn FROM (
    SELECT b.id, p.id AS pid, CASE WHEN p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1 THEN 0 WHEN pow(p.x - (b.x0 + b.x1) / 2, 2) + pow(p.y - (b.y0 + b.y1) / 2, 2) <= 2500 THEN 1 END AS mode,
    pow(p.x - (b.x0 + b.x1) / 2, 2) + pow(p.y - (b.y0 + b.y1) / 2, 2) AS d2 FROM {BOXES} b JOIN {POINTS} p ON p.label % 3 = 0) WHERE mode IS NOT NULL) WHERE rn = 1"""
)
def contain_else_near(spark, sf_dir):
    p = points(spark, sf_dir).where("label % 3 = 0").select(F.col("id").alias("pid"), "x", "y")
    return spatial.contain_else_near(boxes(spark, sf_dir), p, 50.0, 60.0)


@query(f"SELECT p.id, (SELECT min(b.seq) FROM {BOXES} b WHERE p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1) AS seq FROM {POINTS} p")
def point_in_first_feature(spark, sf_dir):
    return spatial.first_feature(points(spark, sf_dir).select("id", "x", "y"), boxes(spark, sf_dir).drop("id"), 60.0).select("id", "seq")


@query(f"SELECT b.id, count(*) AS n, CAST(sum(p.area) AS BIGINT) AS area, max(p.area) AS highest FROM {BOXES} b JOIN {POINTS} p ON p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1 GROUP BY b.id")
def parts_in_footprint(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "x", "y", "area")
    return spatial.box_join_count(p, boxes(spark, sf_dir), 60.0, [F.count(F.lit(1)).alias("n"), F.sum("area").cast("long").alias("area"), F.max("area").alias("highest")])


_BIN = "CAST(floor(log10(greatest(area, 1e-6)) * 2) AS BIGINT)"
_MATCH = f"""(SELECT id, cid, rank, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cost, 9), cid) AS rank FROM (
    SELECT *, sqrt(d2) / 150 + abs(log10(area) - log10(area2)) AS cost, row_number() OVER (PARTITION BY id, bin2 ORDER BY d2, cid) AS near FROM (
    SELECT a.id, b.id AS cid, {_OTHER} AS d2, a.area, b.area AS area2, b.bin AS bin2 FROM (SELECT *, {_BIN} AS bin FROM {POINTS}) a JOIN (SELECT *, {_BIN} AS bin FROM {POINTS}) b
    ON a.label % 2 = 0 AND b.label % 2 = 1 AND abs(a.bin - b.bin) <= 2 AND {_OTHER} <= 150 * 150)) WHERE near <= 24) WHERE rank <= 3)"""


def _matches(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir).withColumn("bin", signals.log_area_bin(F.col("area")))
    got = spatial.match(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 150.0, 8)
    # costs are rounded for the ranking alone: logarithms differ in the last place between engines
    return spatial.nearest(got.drop("rank").withColumn("cost", F.round("cost", 9)), "id", ["cost", "cid"], 3)


@query(f"SELECT id, cid, rank, d2 FROM {_MATCH}")
def knn_match(spark, sf_dir):
    return _matches(spark, sf_dir).select("id", "cid", "rank", "d2")


@query(
    f"""SELECT count(DISTINCT id) AS targets, count(*) AS pairs, list_sort(list(d2))[least(count(*), CAST(floor(count(*) * 0.5) AS BIGINT) + 1)] AS median_d2, list_sort(list(d2))[least(count(*), CAST(floor(count(*) * 0.9) AS BIGINT) + 1)] AS p90_d2,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM {_MATCH} GROUP BY cid)) AS most_used, (SELECT count(*) FROM (SELECT cid FROM {_MATCH} GROUP BY cid HAVING count(*) > 1)) AS reused FROM {_MATCH}"""
)
def match_summary(spark, sf_dir):
    m = Scratch(spark, "matches").save(_matches(spark, sf_dir), "matches")
    use = m.groupBy("cid").count().agg(F.max("count").alias("most_used"), F.count_if(F.col("count") > 1).alias("reused"))
    # sorted once and numbered within bands of distance, quantiles need no list of all rows
    per = m.groupBy("d2").count().withColumn("upto", F.sum("count").over(Window.orderBy("d2").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = m.agg(F.countDistinct("id").alias("targets"), F.count(F.lit(1)).alias("pairs"))
    at = per.crossJoin(total).agg(*(F.min(F.when(F.col("upto") > F.floor(F.col("pairs") * q), F.col("d2"))).alias(n) for q, n in ((0.5, "median_d2"), (0.9, "p90_d2"))))
    return total.crossJoin(at).crossJoin(use).select("targets", "pairs", "median_d2", "p90_d2", "most_used", "reused")


@query(
    f"""SELECT count(*) AS n, round(avg(diff), 9) AS mean, round(stddev_samp(diff), 9) AS sd, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 7) AS z FROM (
    SELECT m.id, any_value(t.area % 10) - avg(c.area % 10) AS diff FROM {_MATCH} m JOIN {POINTS} t ON t.id = m.id JOIN {POINTS} c ON c.id = m.cid GROUP BY m.id)"""
)
def matched_difference(spark, sf_dir):
    p = points(spark, sf_dir).select("id", (F.col("area") % 10).alias("v"))
    met = _matches(spark, sf_dir).select("id", "cid").join(p, "id").join(p.select(F.col("id").alias("cid"), F.col("v").alias("v2")), "cid")
    diff = met.groupBy("id").agg((F.first("v") - F.avg("v2")).alias("diff"))
    out = diff.agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"))
    return out.select("n", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), F.round(F.col("mean") / (F.col("sd") / F.sqrt("n")), 7).alias("z"))


@query(
    f"""WITH m AS (SELECT x.id, a.area AS area, c.area AS area2, floor(a.x / 100) AS cell, floor(c.x / 100) AS cell2, a.label AS label, c.label AS label2 FROM {_MATCH} x JOIN {POINTS} a ON a.id = x.id JOIN {POINTS} c ON c.id = x.cid)
    SELECT 'cell' AS covariate, count(*) AS pairs, round(100.0 * count(*) FILTER (cell = cell2) / count(*), 6) AS exact_pct, count(DISTINCT cell) AS distinct_targets, CAST(NULL AS DOUBLE) AS mean_gap FROM m
    UNION ALL SELECT 'label', count(*), round(100.0 * count(*) FILTER (label = label2) / count(*), 6), count(DISTINCT label), NULL FROM m UNION ALL SELECT 'area_gap', count(*), NULL, NULL, round(avg(abs(area - area2)), 6) FROM m"""
)
def match_balance(spark, sf_dir):
    """How alike targets and their controls are: equal covariates, and the mean gap of the areas, in one pass over the pairs."""
    p = points(spark, sf_dir).select("id", "area", F.floor(F.col("x") / 100).alias("cell"), "label")
    m = _matches(spark, sf_dir).select("id", "cid").join(p, "id").join(p.select(F.col("id").alias("cid"), *(F.col(c).alias(f"{c}2") for c in ("area", "cell", "label"))), "cid")
    same = lambda c: F.round(F.lit(100.0) * F.count_if(F.col(c) == F.col(f"{c}2")) / F.count(F.lit(1)), 6)
    none = lambda kind: F.lit(None).cast(kind)
    one = m.agg(F.count(F.lit(1)).alias("pairs"), same("cell").alias("cell"), same("label").alias("label"), F.countDistinct("cell").alias("cells"), F.countDistinct("label").alias("labels"), F.round(F.avg(F.abs(F.col("area") - F.col("area2"))), 6).alias("gap"))
    row = lambda name, exact, distinct, gap: F.struct(F.lit(name).alias("covariate"), exact.alias("exact_pct"), distinct.alias("distinct_targets"), gap.alias("mean_gap"))
    listed = F.array(row("cell", F.col("cell"), F.col("cells"), none("double")), row("label", F.col("label"), F.col("labels"), none("double")), row("area_gap", none("double"), none("bigint"), F.col("gap")))
    return one.select("pairs", F.explode(listed).alias("x")).select("x.covariate", "pairs", "x.exact_pct", "x.distinct_targets", "x.mean_gap")


@query()
def strict_match(spark, sf_dir):
    """Matching without reuse within strata: a sequence of choices, tested against a plain version."""
    p = points(spark, sf_dir).withColumn("bin", signals.log_area_bin(F.col("area"))).withColumn("stratum", F.floor(F.col("x") / 100))
    got = spatial.match(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 150.0, 12, hard=["stratum"])
    return spatial.assign_once(got, Scratch(spark, "once"))


@query()
def strict_eras(spark, sf_dir):
    """Strict matches where two known eras that differ cost more, counted; tested against a plain version."""
    p = points(spark, sf_dir).withColumn("bin", signals.log_area_bin(F.col("area")))
    pairs = spatial.match(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 150.0, 12)
    era = F.when(F.col("id") % 5 > 0, F.concat(F.lit("era "), F.floor(F.col("area") / 400).cast("string")))
    covariates = p.select("id", F.concat_ws(":", F.floor(F.col("x") / 200), F.floor(F.col("y") / 200)).alias("stratum"), era.alias("era"), (F.col("area") % 10).alias("score"))
    got = spatial.strict_match(pairs, covariates, Scratch(spark, "strict"))
    return spatial.strict_summary(p.where("label % 2 = 0"), got, 1)


@query(
    f"""WITH p AS {POINTS}, m AS (SELECT min(x) AS x0, max(x) - min(x) AS w, min(y) AS y0, max(y) - min(y) AS h, count(*) AS n FROM p)
    SELECT r.r, round(coalesce(sum(CASE WHEN d2 <= r.r * r.r THEN w * h / ((w - dx) * (h - dy)) END), 0) * any_value(w * h) / any_value(n * (n - 1)), 4) AS k
    FROM (VALUES (10.0::DOUBLE), (20.0::DOUBLE), (40.0::DOUBLE)) r(r) CROSS JOIN (SELECT abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, {_OTHER} AS d2, w, h, n FROM p a JOIN p b ON a.id <> b.id AND {_OTHER} <= 1600 CROSS JOIN m) GROUP BY r.r"""
)
def ripley_k(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "x", "y")
    box = p.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return spatial.ripley(p, [10.0, 20.0, 40.0], box[0], box[1]).select("r", F.round("k", 4).alias("k"))


@query(
    f"""WITH p AS {POINTS}, e AS {_NN}, m AS (SELECT avg(area) AS m, count(*) AS n FROM p)
    SELECT any_value(m.n) AS n, count(*) AS edges, round(any_value(m.n) / count(*) * sum((a.area - m.m) * (b.area - m.m)) / (SELECT sum((area - m.m) * (area - m.m)) FROM p, m), 9) AS moran_i FROM e JOIN p a ON a.id = e.id JOIN p b ON b.id = e.id2 CROSS JOIN m"""
)
def moran_i(spark, sf_dir):
    p = points(spark, sf_dir)
    edges = _near(p, 2).select("id", "id2")
    return spatial.moran(p.select("id", F.col("area").alias("v")), edges).select("n", "edges", F.round("moran_i", 9).alias("moran_i"))


_EIGHT = f"(SELECT * FROM (SELECT a.id, b.id AS id2, {_OTHER} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_OTHER}, b.id) AS rank FROM {POINTS} a JOIN {POINTS} b ON a.id <> b.id) WHERE rank <= 8)"


@query(f"SELECT id, id2, d2, rank FROM {_EIGHT}")
def eight_nearest(spark, sf_dir):
    p = points(spark, sf_dir)
    return neighbours.k_nearest(p, p, 8, Scratch(spark, "eight"), others=True)


@query(
    f"""WITH p AS {POINTS}, e AS (SELECT DISTINCT least(id, id2) AS id, greatest(id, id2) AS id2 FROM {_EIGHT}), m AS (SELECT avg(area) AS m, count(*) AS n FROM p)
    SELECT any_value(m.n) AS n, count(*) AS edges, round(any_value(m.n) / count(*) * sum((a.area - m.m) * (b.area - m.m)) / (SELECT sum((area - m.m) * (area - m.m)) FROM p, m), 9) AS moran_i FROM e JOIN p a ON a.id = e.id JOIN p b ON b.id = e.id2 CROSS JOIN m"""
)
def moran_of_eight(spark, sf_dir):
    """Moran's I over the graph of the eight nearest, at whatever distance, each link once."""
    p = points(spark, sf_dir)
    edges = spatial.unordered(neighbours.k_nearest(p, p, 8, Scratch(spark, "eight"), others=True), "id", "id2")
    return spatial.moran(p.select("id", F.col("area").alias("v")), edges).select("n", "edges", F.round("moran_i", 9).alias("moran_i"))


_ANGLE = "(degrees(atan2(b.y - a.y, b.x - a.x)) + 360) % 180"


@query(
    f"""SELECT g AS peak, n FROM (SELECT g, count(*) FILTER (abs(bearing - g) <= 10) AS n FROM (SELECT unnest(range(180)) AS g) CROSS JOIN (SELECT round({_ANGLE}, 6) AS bearing FROM {_NN} e JOIN {POINTS} a ON a.id = e.id JOIN {POINTS} b ON b.id = e.id2) GROUP BY g) ORDER BY n DESC, g LIMIT 1"""
)
def peak_band(spark, sf_dir):
    """The direction, of 180, that the most links lie near; a link is counted in the bands that it is in."""
    p = points(spark, sf_dir)
    e = _near(p, 2)
    b = F.round(geo.undirected_bearing(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")), 6)
    hit = e.select(F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(b - 10)), F.least(F.lit(179), F.floor(b + 10)))).alias("peak"))
    return hit.groupBy("peak").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "peak").limit(1).select(F.col("peak").cast("long").alias("peak"), "n")


@query(
    f"""SELECT a.h AS degree, coalesce(s.n, 0) AS neighbours, coalesce(t.n, 0) AS boxes FROM (SELECT unnest(range(0, 180, 10)) AS h) a
    LEFT JOIN (SELECT CAST(floor(round({_ANGLE}, 6) / 10) * 10 AS BIGINT) AS h, count(*) AS n FROM {_NN} e JOIN {POINTS} a ON a.id = e.id JOIN {POINTS} b ON b.id = e.id2 GROUP BY 1) s USING (h)
    LEFT JOIN (SELECT CAST(floor(area % 180 / 10) * 10 AS BIGINT) AS h, count(*) AS n FROM {POINTS} GROUP BY 1) t USING (h)"""
)
def bearing_histograms(spark, sf_dir):
    p = points(spark, sf_dir)
    e = _near(p, 2)
    b = F.round(geo.undirected_bearing(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")), 6)
    one = e.groupBy((F.floor(b / 10) * 10).alias("degree")).agg(F.count(F.lit(1)).alias("neighbours"))
    two = p.groupBy((F.floor(F.col("area") % 180 / 10) * 10).alias("degree")).agg(F.count(F.lit(1)).alias("boxes"))
    grid = spark.range(0, 180, 10).select(F.col("id").alias("degree"))
    return grid.join(one, "degree", "left").join(two, "degree", "left").na.fill(0)


@query(
    f"""SELECT CAST(floor(x / 50) AS BIGINT) AS cx, CAST(floor(y / 50) AS BIGINT) AS cy, id, n, CASE WHEN n <= 1 THEN 'sparse' WHEN n <= 5 THEN 'low' WHEN n <= 20 THEN 'medium' ELSE 'high' END AS density,
    CAST(floor(x / 50) AS BIGINT) || ':' || CAST(floor(y / 50) AS BIGINT) || ':' || {_BIN} AS stratum FROM (SELECT *, count(*) OVER (PARTITION BY floor(x / 50), floor(y / 50)) AS n FROM {POINTS})"""
)
def grid_cells(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("cx", geo.cell(F.col("x"), 50.0)).withColumn("cy", geo.cell(F.col("y"), 50.0))
    counts = p.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))  # counted, then joined: a full cell is not sorted in one task
    out = p.join(counts, ["cx", "cy"])
    return out.select("cx", "cy", "id", "n", signals.density_bin(F.col("n")).alias("density"), F.concat_ws(":", "cx", "cy", signals.log_area_bin(F.col("area"))).alias("stratum"))


@query(
    f"""SELECT id, round(min(d), 6) AS distance FROM (SELECT p.id, sqrt(pow(p.x - (s.ax + t * (s.bx - s.ax)), 2) + pow(p.y - (s.ay + t * (s.by_ - s.ay)), 2)) AS d FROM (
    SELECT p.*, s.*, CASE WHEN l2 > 0 THEN greatest(0.0, least(1.0, ((p.x - s.ax) * (s.bx - s.ax) + (p.y - s.ay) * (s.by_ - s.ay)) / l2)) ELSE 0.0 END AS t FROM {POINTS} p CROSS JOIN (
    SELECT x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by_, pow(x1 - x0, 2) + pow(y1 - y0, 2) AS l2 FROM {BOXES}) s) AS q(id, x, y, area, label, ax, ay, bx, by_, l2, t), LATERAL (SELECT id, x, y) p, LATERAL (SELECT ax, ay, bx, by_) s) WHERE d <= 40 GROUP BY id"""
)
def nearest_line(spark, sf_dir):
    """Distance of each point to the nearest segment within 40; segments are spread over the cells they pass."""
    lines = boxes(spark, sf_dir)
    cell = 60.0
    low, high = lambda a: F.floor((F.col(a) - 40.0) / cell), lambda a: F.floor((F.col(a) + 40.0) / cell)
    spread = lines.withColumn("_cx", F.explode(F.sequence(low("x0"), high("x1")))).withColumn("_cy", F.explode(F.sequence(low("y0"), high("y1")))).drop("id", "seq")
    met = points(spark, sf_dir).withColumn("_cx", geo.cell(F.col("x"), cell)).withColumn("_cy", geo.cell(F.col("y"), cell)).join(spread, ["_cx", "_cy"])
    d = geo.segment_distance(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    return met.withColumn("d", d).where("d <= 40").groupBy("id").agg(F.round(F.min("d"), 6).alias("distance"))


_NEAREST = f"(SELECT a.id, a.label AS grp, sqrt(min({_OTHER})) AS d FROM {POINTS} a JOIN {POINTS} b ON b.label = 1 AND a.label <> 1 GROUP BY a.id, a.label)"


@query(
    f"""SELECT grp, count(*) AS n, round(avg(d), 6) AS mean, round(list_sort(list(d))[least(count(*), CAST(floor(count(*) * 0.5) AS BIGINT) + 1)], 6) AS median, round(list_sort(list(d))[least(count(*), CAST(floor(count(*) * 0.9) AS BIGINT) + 1)], 6) AS p90,
    round(100.0 * count(*) FILTER (d <= 25) / count(*), 6) AS within_25, round(100.0 * count(*) FILTER (d <= 100) / count(*), 6) AS within_100 FROM {_NEAREST} GROUP BY grp"""
)
def proximity_summary(spark, sf_dir):
    """Mean, upper median, 90th and share within bounds of the distances to the nearest control."""
    p = points(spark, sf_dir)
    got = neighbours.k_nearest(p.where("label <> 1"), p.where("label = 1"), 1, Scratch(spark, "nearest"))
    d = got.join(p.select("id", F.col("label").alias("grp")), "id").select(F.sqrt("d2").alias("d"), "grp")
    share = lambda far: F.round(F.lit(100.0) * F.count_if(F.col("d") <= far) / F.count(F.lit(1)), 6)
    out = d.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean"), share(25).alias("within_25"), share(100).alias("within_100"))
    at = stats.quantiles(d, ["grp"], "d", 1.0, {"median": 0.5, "p90": 0.9})
    return out.join(at, "grp").select("grp", "n", "mean", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), "within_25", "within_100")


@query(
    """SELECT vec_id AS id, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b - 53.2) / 2), 2) + cos(radians(53.2)) * cos(radians(b)) * pow(sin(radians(a + 7.5) / 2), 2)))), 3) AS haversine,
    round(sqrt(pow((a + 7.5) * cos(radians((b + 53.2) / 2)) * 111320.0, 2) + pow((b - 53.2) * 110540.0, 2)), 3) AS equirect
    FROM (SELECT vec_id, embedding[1]::DOUBLE - 7 AS a, embedding[2]::DOUBLE + 53 AS b FROM embeddings)"""
)
def geo_distances(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") - 7).alias("lon"), (F.col("embedding")[1].cast("double") + 53).alias("lat"))
    at = (F.lit(53.2), F.lit(-7.5), F.col("lat"), F.col("lon"))
    return p.select("id", F.round(geo.haversine(*at), 3).alias("haversine"), F.round(geo.equirect(*at), 3).alias("equirect"))


@query(
    f"""WITH h AS (SELECT a.h AS degree, coalesce(s.n, 0) AS x, coalesce(t.n, 0) AS y FROM (SELECT unnest(range(180)) AS h) a
    LEFT JOIN (SELECT CAST(floor(round({_ANGLE}, 6)) AS BIGINT) AS h, count(*) AS n FROM {_NN} e JOIN {POINTS} a ON a.id = e.id JOIN {POINTS} b ON b.id = e.id2 GROUP BY 1) s USING (h)
    LEFT JOIN (SELECT CAST(area % 180 AS BIGINT) AS h, count(*) AS n FROM {POINTS} GROUP BY 1) t USING (h))
    SELECT round(corr(x, y), 9) AS r, CASE WHEN abs(corr(x, y)) >= 0.40 THEN 'explains' WHEN abs(corr(x, y)) >= 0.15 THEN 'partly' ELSE 'not' END AS verdict FROM h"""
)
def histogram_correlation(spark, sf_dir):
    """Correlation of two histograms by degree, empty degrees included, and what it says."""
    p = points(spark, sf_dir)
    e = _near(p, 2)
    b = F.round(geo.undirected_bearing(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")), 6)
    one = e.groupBy(F.floor(b).alias("degree")).agg(F.count(F.lit(1)).alias("x"))
    two = p.groupBy((F.col("area") % 180).cast("long").alias("degree")).agg(F.count(F.lit(1)).alias("y"))
    met = spark.range(180).select(F.col("id").alias("degree")).join(one, "degree", "left").join(two, "degree", "left").na.fill(0)
    out = met.agg(F.corr("x", "y").alias("r"))
    size = F.abs("r")
    return out.select(F.round("r", 9).alias("r"), F.when(size >= 0.40, "explains").when(size >= 0.15, "partly").otherwise("not").alias("verdict"))


@query(
    f"""SELECT count(*) AS n, count(*) FILTER (list_bool_or(list_transform([5, 8, 13, 21, 34, 55], lambda f: abs(d - f) / f::DOUBLE <= 0.03))) AS fibonacci, count(*) FILTER (list_bool_or(list_transform([6, 10, 15, 24, 38, 50], lambda f: abs(d - f) / f::DOUBLE <= 0.03))) AS sham
    FROM (SELECT sqrt({_OTHER}) AS d FROM {_NN} e JOIN {POINTS} a ON a.id = e.id JOIN {POINTS} b ON b.id = e.id2)"""
)
def fibonacci_distances(spark, sf_dir):
    """Distances to neighbours near Fibonacci numbers and near others of the same size."""
    p = points(spark, sf_dir)
    e = _near(p, 2).withColumn("d", F.sqrt("d2"))
    near = lambda values: F.exists(F.array(*map(F.lit, values)), lambda f: F.abs(F.col("d") - f) / f <= 0.03)
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(near([5, 8, 13, 21, 34, 55])).alias("fibonacci"), F.count_if(near([6, 10, 15, 24, 38, 50])).alias("sham"))


@query()
def fibonacci_null(spark, sf_dir):
    """Nearest distances near Fibonacci numbers against those of random points in the same box; tested against a plain simulation."""
    near = F.exists(F.array(*map(F.lit, [5, 8, 13, 21, 34, 55])), lambda f: F.abs(F.col("d") - f) / f <= 0.03)
    return sample.cloud_null(points(spark, sf_dir).select("id", "x", "y"), near, Scratch(spark, "clouds"), iterations=50)


@query()
def orientation_null(spark, sf_dir):
    """Links near the golden direction, and the most near any, against directions drawn evenly."""
    p = points(spark, sf_dir)
    e = _near(p, 2)
    b = geo.undirected_bearing(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    e = Scratch(spark, "bearings").save(e.select(b.alias("b")), "bearings")
    peak = e.select(F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col("b") - 10)), F.least(F.lit(179), F.floor(F.col("b") + 10)))).alias("g")).groupBy("g").count().agg(F.max("count").alias("peak"))
    near = lambda off: F.count_if(F.abs(F.col("b") - geo.GOLDEN_ANGLE) <= off)
    seen = e.agg(F.count(F.lit(1)).alias("n"), near(3.0).alias("wide"), near(1.0).alias("core")).crossJoin(peak)  # one row each
    return sample.orientation_null(seen)


@query()
def moran_permutation(spark, sf_dir):
    """Moran's I of one label's points against the same number of points at random."""
    p = points(spark, sf_dir)
    edges = _near(p, 2).select("id", "id2")
    return sample.moran_permutation(p.select("id", (F.col("label") == 1).cast("double").alias("v")), edges)
