"""Rates of targets against controls, tests, strata and pooled effects.

Orders stand for analysed rows: priority is the group, status F a control; the
price in cents gives an aspect ratio from 1 to 3 and an angle below 180 degrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import signals, stats
from fathomline.operators import quality, rates
from fathomline.plans.registry import query, table


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("grp"),
        (F.col("o_orderstatus") == "F").alias("is_control"),
        cents.alias("cents"),
        (1 + cents % 2000 / 1000.0).alias("aspect"),
        (cents % 18000 / 100.0).alias("angle"),
        F.year("o_orderdate").alias("year"),
        F.col("o_custkey").alias("cust"),
    )


ROWS = """(SELECT o_orderkey AS id, o_orderpriority AS grp, o_orderstatus = 'F' AS is_control, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    1 + (CAST(round(o_totalprice * 100) AS BIGINT) % 2000) / 1000.0::DOUBLE AS aspect, (CAST(round(o_totalprice * 100) AS BIGINT) % 18000) / 100.0::DOUBLE AS angle,
    year(o_orderdate) AS year, o_custkey AS cust FROM orders)"""
FIB = "[1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE/2, 5.0::DOUBLE/3, 8.0::DOUBLE/5, 13.0::DOUBLE/8, 21.0::DOUBLE/13, 34.0::DOUBLE/21, 55.0::DOUBLE/34, 89.0::DOUBLE/55, 144.0::DOUBLE/89, 233.0::DOUBLE/144, 377.0::DOUBLE/233, 610.0::DOUBLE/377]"
SIGNALS_SQL = f"""(SELECT *, abs(angle - 137.50776405003785) <= 3 AS golden_angle, abs(aspect - 1.618033988749895) / 1.618033988749895 * 100 <= 3 AS golden_ratio,
    list_min(list_transform({FIB}, lambda f: abs(aspect - f) / f * 100)) <= 2 AS fib_ratio, abs(angle - 60) <= 3 AS has_60, abs(angle - 120) <= 3 AS has_120 FROM {ROWS})"""
LONG = f"""(SELECT id, grp, is_control, year, cust, cents, signal, hit FROM (SELECT id, grp, is_control, year, cust, cents, unnest(['golden_angle', 'golden_ratio', 'fib_ratio']) AS signal,
    unnest([golden_angle, golden_ratio, fib_ratio]) AS hit FROM {SIGNALS_SQL}))"""
RATES = f"""(SELECT t.grp, t.signal, t.k1, t.n1, c.k2, c.n2 FROM (SELECT grp, signal, count(*) FILTER (hit) AS k1, count(*) AS n1 FROM {LONG} WHERE NOT is_control GROUP BY ALL) t
    JOIN (SELECT signal, count(*) FILTER (hit) AS k2, count(*) AS n2 FROM {LONG} WHERE is_control GROUP BY ALL) c USING (signal))"""


def _rates(spark, sf_dir) -> DataFrame:
    return rates.against_controls(analysed(spark, sf_dir), signals.PRIMARY)


@query(f"SELECT grp, signal, k1, n1, k2, n2, k1 / n1::DOUBLE AS rate1, k2 / n2::DOUBLE AS rate2, k1 / n1::DOUBLE - k2 / n2::DOUBLE AS risk_difference FROM {RATES}")
def group_rates(spark, sf_dir):
    k1, n1, k2, n2 = (F.col(c) for c in ("k1", "n1", "k2", "n2"))
    return _rates(spark, sf_dir).withColumns({"rate1": stats.rate(k1, n1), "rate2": stats.rate(k2, n2)}).withColumn("risk_difference", F.col("rate1") - F.col("rate2"))


@query(
    f"""SELECT signal, count(*) FILTER (NOT is_control) AS n1, count(*) FILTER (hit AND NOT is_control) AS k1, count(*) FILTER (is_control) AS n2, count(*) FILTER (hit AND is_control) AS k2
    FROM (SELECT is_control, unnest(['has_60', 'has_120']) AS signal, unnest([has_60, has_120]) AS hit FROM {SIGNALS_SQL}) GROUP BY signal"""
)
def negative_controls(spark, sf_dir):
    rows = rates.long_signals(analysed(spark, sf_dir), signals.NEGATIVE)
    t, h = ~F.col("is_control"), F.col("hit")
    return rows.groupBy("signal").agg(F.count_if(t).alias("n1"), F.count_if(t & h).alias("k1"), F.count_if(~t).alias("n2"), F.count_if(~t & h).alias("k2"))


_Z = "1.959963984540054::DOUBLE"


def _wilson_sql(k, n):
    p, z2 = f"({k} / {n}::DOUBLE)", f"({_Z} * {_Z})"
    denom = f"(1 + {z2} / {n})"
    centre = f"(({p} + {z2} / (2 * {n})) / {denom})"
    half = f"({_Z} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})) / {denom})"
    return f"greatest(0.0::DOUBLE, {centre} - {half})", f"least(1.0::DOUBLE, {centre} + {half})"


@query(f"SELECT grp, signal, round({_wilson_sql('k1', 'n1')[0]}, 9) AS low, round({_wilson_sql('k1', 'n1')[1]}, 9) AS high FROM {RATES}")
def wilson_intervals(spark, sf_dir):
    low, high = stats.wilson(F.col("k1"), F.col("n1"))
    return _rates(spark, sf_dir).select("grp", "signal", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_OR = "((k1 + 0.5::DOUBLE) * (greatest(0, n2 - k2) + 0.5::DOUBLE)) / ((greatest(0, n1 - k1) + 0.5::DOUBLE) * (k2 + 0.5::DOUBLE))"
_POOL = "((k1 + k2) / (n1 + n2)::DOUBLE)"
_PZ = f"(k1 / n1::DOUBLE - k2 / n2::DOUBLE) / sqrt({_POOL} * (1 - {_POOL}) * (1 / n1::DOUBLE + 1 / n2::DOUBLE))"
_UZ = "(k1 / n1::DOUBLE - k2 / n2::DOUBLE) / sqrt(k1 / n1::DOUBLE * (1 - k1 / n1::DOUBLE) / n1 + k2 / n2::DOUBLE * (1 - k2 / n2::DOUBLE) / n2)"


@query(f"SELECT grp, signal, round({_OR}, 9) AS odds_ratio, round({_PZ}, 9) AS pooled_z, round({_UZ}, 9) AS unpooled_z FROM {RATES}")
def proportion_tests(spark, sf_dir):
    cells = [F.col(c) for c in ("k1", "n1", "k2", "n2")]
    made = {"odds_ratio": stats.odds_ratio(*cells), "pooled_z": stats.pooled_z(*cells), "unpooled_z": stats.unpooled_z(*cells)}
    return _rates(spark, sf_dir).select("grp", "signal", *(F.round(c, 9).alias(n) for n, c in made.items()))


def erfc_sql(z: str) -> str:
    """Two-sided p of z in SQL that has no error function: one minus the series of positive terms of erf, 0 where it is below 1e-16."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    term = f"exp(ln({x}) + n * ln(2 * {x} * {x}) - (lgamma(2.0::DOUBLE * n + 2) - n * ln(2.0::DOUBLE) - lgamma(n + 1.0::DOUBLE)))"
    return f"CASE WHEN {x} = 0 THEN 1.0::DOUBLE WHEN {x} > 5.8 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 160), lambda n: {term}))) END"


_SIGNIFICANT = f"""(SELECT *, least(1.0::DOUBLE, max((m - k + 1) * p) OVER (PARTITION BY grp ORDER BY k)) AS p_adjusted FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, signal) AS k, count(*) OVER (PARTITION BY grp) AS m FROM (
    SELECT *, {erfc_sql("z")} AS p FROM (SELECT grp, signal, k1, n1, k2, n2, {_PZ} AS z FROM {RATES}))))"""


@query(
    f"""SELECT grp, signal, k1, n1, k2, n2, round(z, 9) AS z, round(p, 9) AS p, round(p_adjusted, 9) AS p_adjusted, CASE WHEN z > 0 AND p_adjusted < 0.01 THEN 'SIGNAL' WHEN z > 0 AND p_adjusted < 0.05 THEN 'suggestive' ELSE 'background' END AS verdict,
    CASE WHEN p_adjusted < 0.0001 THEN '<0.0001' WHEN p_adjusted < 0.001 THEN '<0.001' ELSE rtrim(rtrim(printf('%.4f', p_adjusted), '0'), '.') END AS p_text FROM {_SIGNIFICANT}"""
)
def significance(spark, sf_dir):
    """p-values, Holm within each group, verdicts and texts."""
    cells = [F.col(c) for c in ("k1", "n1", "k2", "n2")]
    rows = _rates(spark, sf_dir).withColumn("z", stats.pooled_z(*cells))
    rows = stats.holm(rows.withColumn("p", stats.two_sided_p("z")), "p", ["grp"])
    rows = rows.withColumn("verdict", stats.verdict(F.col("p_adjusted"), F.signum("z"))).withColumn("p_text", stats.p_text(F.col("p_adjusted")))
    return rows.withColumns({c: F.round(c, 9) for c in ("z", "p", "p_adjusted")})


_P = "(SELECT id % 40 AS family, id, (cents % 1000) / 10000.0::DOUBLE AS p FROM " + ROWS + ")"


@query(
    f"""SELECT id, family, round(p_adjusted, 12) AS p_adjusted, CASE WHEN p_adjusted < 0.01 THEN 'SIGNAL' WHEN p_adjusted < 0.05 THEN 'suggestive' ELSE 'background' END AS verdict FROM (
    SELECT id, family, least(1.0::DOUBLE, max((m - k + 1) * greatest(p, 1e-300)) OVER (PARTITION BY family ORDER BY k)) AS p_adjusted FROM (
    SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS m FROM {_P}))"""
)
def holm_adjust(spark, sf_dir):
    rows = analysed(spark, sf_dir).select((F.col("id") % 40).alias("family"), "id", (F.col("cents") % 1000 / 10000.0).alias("p"))
    out = stats.holm(rows, "p", ["family"])
    return out.select("id", "family", F.round("p_adjusted", 12).alias("p_adjusted"), stats.verdict(F.col("p_adjusted"), F.lit(1)).alias("verdict"))


_TABLES = f"""(SELECT grp, signal, stratum, count(*) FILTER (NOT is_control AND hit) AS a, count(*) FILTER (NOT is_control AND NOT hit) AS b, count(*) FILTER (is_control AND hit) AS c, count(*) FILTER (is_control AND NOT hit) AS d FROM (
    SELECT g.grp, r.signal, r.hit, r.is_control, r.year || ':' || (r.cust % 5) AS stratum FROM {LONG} r JOIN (SELECT DISTINCT grp FROM {ROWS} WHERE NOT is_control) g ON r.is_control OR r.grp = g.grp) GROUP BY ALL
    HAVING count(*) FILTER (NOT is_control) >= 2 AND count(*) FILTER (is_control) >= 2)"""


def _strata(spark, sf_dir) -> DataFrame:
    rows = analysed(spark, sf_dir).withColumn("stratum", F.concat_ws(":", "year", F.col("cust") % 5))
    return rates.stratum_tables(rows, signals.PRIMARY)


@query(f"SELECT grp, signal, stratum, a, b, c, d FROM {_TABLES}")
def stratum_tables(spark, sf_dir):
    return _strata(spark, sf_dir)


@query(
    f"""WITH e AS (SELECT *, ln(((a + 0.5::DOUBLE) * (d + 0.5::DOUBLE)) / ((b + 0.5::DOUBLE) * (c + 0.5::DOUBLE))) AS e, 1 / (a + 0.5::DOUBLE) + 1 / (b + 0.5::DOUBLE) + 1 / (c + 0.5::DOUBLE) + 1 / (d + 0.5::DOUBLE) AS v FROM {_TABLES}),
    f AS (SELECT grp, signal, count(*) AS k, sum(e / v) / sum(1 / v) AS fixed, greatest(0.0, sum(e * e / v) - sum(e / v) * sum(e / v) / sum(1 / v)) AS q, sum(1 / v) - sum(1 / (v * v)) / sum(1 / v) AS denom FROM e GROUP BY ALL),
    t AS (SELECT *, CASE WHEN denom > 0 THEN greatest(0.0, (q - (k - 1)) / denom) ELSE 0.0 END AS tau2 FROM f)
    SELECT grp, signal, k, round(any_value(fixed), 8) AS fixed_log_or, round(any_value(tau2), 8) AS tau2, round(sum(e / (v + tau2)) / sum(1 / (v + tau2)), 8) AS random_log_or FROM e JOIN t USING (grp, signal) GROUP BY grp, signal, k"""
)
def random_effects(spark, sf_dir):
    out = stats.random_effects(_strata(spark, sf_dir), ["grp", "signal"])
    return out.select("grp", "signal", "k", *(F.round(c, 8).alias(c) for c in ("fixed_log_or", "tau2", "random_log_or")))


_CENTURY = "CASE WHEN y < 1700 THEN 'pre-18th' WHEN y >= 2000 THEN '21st' ELSE (y // 100 + 1) || CASE WHEN (y // 100 + 1) IN (11, 12, 13) THEN 'th' WHEN (y // 100 + 1) % 10 = 1 THEN 'st' WHEN (y // 100 + 1) % 10 = 2 THEN 'nd' WHEN (y // 100 + 1) % 10 = 3 THEN 'rd' ELSE 'th' END END"


@query(
    f"""SELECT century, signal, count(*) FILTER (hit AND NOT is_control) AS k1, count(*) FILTER (NOT is_control) AS n1, count(*) FILTER (hit AND is_control) AS k2, count(*) FILTER (is_control) AS n2
    FROM (SELECT *, {_CENTURY} AS century FROM (SELECT *, 1650 + cust % 400 AS y FROM {LONG})) GROUP BY ALL"""
)
def century_rates(spark, sf_dir):
    rows = analysed(spark, sf_dir).withColumn("y", 1650 + F.col("cust") % 400).withColumn("century", signals.century(F.col("y")))
    return rates.both_sides(rates.long_signals(rows, signals.PRIMARY), ["century", "signal"])


@query(
    f"""SELECT decade, signal, k1, n1, k2, n2 FROM (SELECT y // 10 * 10 AS decade, signal, count(*) FILTER (hit AND NOT is_control) AS k1, count(*) FILTER (NOT is_control) AS n1, count(*) FILTER (hit AND is_control) AS k2, count(*) FILTER (is_control) AS n2
    FROM (SELECT *, 1650 + cust % 400 AS y FROM {LONG}) GROUP BY ALL) WHERE n1 >= 10 AND n2 >= 10"""
)
def decade_rates(spark, sf_dir):
    rows = analysed(spark, sf_dir).withColumn("decade", F.floor((1650 + F.col("cust") % 400) / 10) * 10)
    return rates.both_sides(rates.long_signals(rows, signals.PRIMARY), ["decade", "signal"]).where("n1 >= 10 AND n2 >= 10")


@query(
    f"""SELECT {_CENTURY} AS century, CASE WHEN angle < 136.5 THEN 'octagon-ish' WHEN angle <= 138.5 THEN 'golden-core' ELSE 'high-side' END AS band, count(*) AS n
    FROM (SELECT angle, 1650 + cust % 400 AS y FROM {ROWS} WHERE angle BETWEEN 134.5 AND 140.5) GROUP BY ALL"""
)
def angle_bands(spark, sf_dir):
    rows = analysed(spark, sf_dir).where(F.col("angle").between(134.5, 140.5))
    return rows.groupBy(signals.century(1650 + F.col("cust") % 400).alias("century"), signals.golden_band(F.col("angle")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT cust AS name, signal, count(*) AS n, count(*) FILTER (hit) AS k, count(*) FILTER (hit) / count(*)::DOUBLE AS rate FROM {LONG} WHERE NOT is_control GROUP BY ALL HAVING count(*) >= 4")
def named_rates(spark, sf_dir):
    rows = rates.long_signals(analysed(spark, sf_dir).where(~F.col("is_control")), signals.PRIMARY)
    out = rows.groupBy(F.col("cust").alias("name"), "signal").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("k")).where("n >= 4")
    return out.withColumn("rate", stats.rate(F.col("k"), F.col("n")))


@query(f"SELECT grp, count(*) AS n FROM {ROWS} GROUP BY grp")
def group_counts(spark, sf_dir):
    return analysed(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "grp")


@query(
    f"""SELECT id, round(nearest, 9) AS nearest, round(err, 9) AS err, dim FROM (SELECT id, s.i, {FIB}[s.i] AS nearest, s.err AS err, coalesce(list_filter([5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610], lambda f: abs(dim_in - f) / f::DOUBLE * 100 <= 3)[1], 0) AS dim FROM (
    SELECT id, cents % 70000 / 100.0::DOUBLE AS dim_in, list_min(list_transform(range(1, 15), lambda i: {{'err': abs(aspect - {FIB}[i]) / {FIB}[i] * 100, 'i': i}})) AS s FROM {ROWS}))"""
)
def fibonacci_matches(spark, sf_dir):
    near = signals.nearest_ratio(F.col("aspect"))
    dim = signals.dimension(F.col("cents") % 70000 / 100.0)
    return analysed(spark, sf_dir).select("id", F.round(near["ratio"], 9).alias("nearest"), F.round(near["err"], 9).alias("err"), dim.cast("int").alias("dim"))


@query(
    f"""SELECT id, concat_ws(',', CASE WHEN golden_ratio THEN 'golden_ratio' END, CASE WHEN fib_ratio AND n <> 1 THEN 'fib_ratio' END, CASE WHEN golden_angle THEN 'golden_angle' END) AS flags,
    least(100.0::DOUBLE, (CASE WHEN golden_ratio THEN 25 ELSE 0 END + CASE WHEN fib_ratio AND n <> 1 THEN 15 ELSE 0 END + CASE WHEN golden_angle THEN 8 ELSE 0 END + CASE WHEN abs(angle - 108) <= 3 THEN 3 ELSE 0 END + CASE WHEN has_120 THEN 2 ELSE 0 END)::DOUBLE) AS score
    FROM (SELECT *, list_min(list_transform(range(1, 15), lambda i: {{'err': abs(aspect - {FIB}[i]) / {FIB}[i] * 100, 'i': i}})).i AS n FROM {SIGNALS_SQL})"""
)
def flags_and_score(spark, sf_dir):
    none = F.lit(0.0)
    shape = {"aspect": F.col("aspect"), "golden_angle": signals.golden_angle(F.col("angle")), "has_108": signals.near(F.col("angle"), 108), "has_120": signals.near(F.col("angle"), 120)}
    for name in ("length_m", "width_m", "right_fraction", "reflect", "rot180", "rot90", "rot60", "rot45", "rot72", "circularity", "area_m2", "vertices"):
        shape[name] = none
    shape["convexity"] = F.lit(1.0)
    return analysed(spark, sf_dir).select("id", signals.flags(shape).alias("flags"), signals.score(shape).alias("score"))


@query(
    f"""SELECT p_partkey AS id, CASE WHEN p_type LIKE '%BRASS' THEN 'worship' WHEN p_brand = 'Brand#11' OR p_size < 5 THEN 'government' WHEN p_type LIKE '%TIN' THEN 'civic' WHEN p_size > 45 THEN 'historic' ELSE 'other' END AS kind FROM part"""
)
def classify_case(spark, sf_dir):
    """Tags made from parts: first rule that holds wins."""
    part = table(spark, sf_dir, "part")
    building = F.when(F.col("p_type").like("%BRASS"), "church").when(F.col("p_size") < 5, "courthouse").when(F.col("p_type").like("%TIN"), "bank").otherwise("yes")
    office = F.when(F.col("p_brand") == "Brand#11", "government").otherwise("")
    tags = F.create_map(F.lit("building"), building, F.lit("office"), office, F.lit("historic"), F.when(F.col("p_size") > 45, "ruin").otherwise(""))
    return part.select(F.col("p_partkey").alias("id"), tags.alias("tags")).select("id", signals.classify(F.col("tags")).alias("kind"))


@query(
    """SELECT t.id, t.distance, t.control_id, row_number() OVER (PARTITION BY t.id ORDER BY t.distance, t.control_id) AS rank FROM (
    SELECT a.o_orderkey AS id, b.o_orderkey AS control_id, abs(CAST(round(a.o_totalprice * 100) AS BIGINT) - CAST(round(b.o_totalprice * 100) AS BIGINT)) AS distance,
    row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(CAST(round(a.o_totalprice * 100) AS BIGINT) - CAST(round(b.o_totalprice * 100) AS BIGINT)), b.o_orderkey) AS rn
    FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderstatus = 'F' AND a.o_orderstatus <> 'F') t WHERE rn <= 3"""
)
def ranked_matches(spark, sf_dir):
    rows = analysed(spark, sf_dir)
    left, right = rows.where(~F.col("is_control")).select("id", "cust", "cents"), rows.where("is_control").select(F.col("id").alias("control_id"), "cust", F.col("cents").alias("cents2"))
    met = left.join(right, "cust").withColumn("distance", F.abs(F.col("cents") - F.col("cents2")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "control_id"))
    return met.withColumn("rank", rank).where("rank <= 3").select("id", "distance", "control_id", "rank")


_PUBLISHED = "id % 101 <> 5"
_DIFFERENT = f"""(SELECT id, 'left only' AS what FROM {ROWS} WHERE id % 103 = 7 AND {_PUBLISHED} UNION ALL SELECT id, 'right only' FROM {ROWS} WHERE NOT ({_PUBLISHED}) AND id % 103 <> 7 UNION ALL
    SELECT id, 'p_adjusted' FROM {ROWS} WHERE {_PUBLISHED} AND id % 103 <> 7 AND id % 97 = 0 UNION ALL SELECT id, 'verdict' FROM {ROWS} WHERE {_PUBLISHED} AND id % 103 <> 7 AND id % 89 = 1 UNION ALL SELECT id, 'left repeated' FROM {ROWS} WHERE {_PUBLISHED} AND id % 499 = 3)"""


@query(
    f"""SELECT what, n, keys FROM (SELECT what, count(DISTINCT (id, copy)) AS n FROM (SELECT *, unnest(range(CASE WHEN id % 499 = 3 AND what NOT IN ('left repeated', 'right only') THEN 2 ELSE 1 END)) AS copy FROM {_DIFFERENT}) GROUP BY what)
    JOIN (SELECT what, string_agg(key, ',' ORDER BY key) AS keys FROM (SELECT what, id::VARCHAR AS key, row_number() OVER (PARTITION BY what ORDER BY id::VARCHAR) AS rank FROM (SELECT *, unnest(range(CASE WHEN id % 499 = 3 AND what NOT IN ('left repeated', 'right only') THEN 2 ELSE 1 END)) AS copy FROM {_DIFFERENT})) WHERE rank <= 5 GROUP BY what) USING (what)"""
)
def recomputed_results(spark, sf_dir):
    """Adjusted p-values and verdicts as published, with planted errors, against those computed again: what differs, how often and where first."""
    again = holm_adjust(spark, sf_dir).select("id", "p_adjusted", "verdict")
    said = again.where(F.col("id") % 101 != 5).withColumn("p_adjusted", F.col("p_adjusted") + F.when(F.col("id") % 97 == 0, 0.5).otherwise(1e-9))
    said = said.withColumn("verdict", F.when(F.col("id") % 89 == 1, F.concat("verdict", F.lit("?"))).otherwise(F.col("verdict")))
    said = said.unionByName(said.where("id % 499 = 3"))
    got = quality.differences(said, again.where("id % 103 <> 7"), ["id"], {"p_adjusted": 1e-6, "verdict": None})
    return got.select("what", "n", F.array_join(F.transform("samples", lambda x: x["key"]), ",").alias("keys"))
