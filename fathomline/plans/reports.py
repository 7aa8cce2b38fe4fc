"""Filtered reports, subgroup comparisons, evidence records, vehicle limits and coverage over the given tables.

Orders stand for rows of a report, parts for entities, line items for the matches
between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import geo, limits, rules, schedule, signals, stats
from fathomline.operators import quality, rates, select
from fathomline.plans.rates import FIB, LONG, ROWS, analysed
from fathomline.plans.registry import query, table


def rows(spark, sf_dir) -> DataFrame:
    """Report rows with every column that a report can be filtered by."""
    c, none = F.col("cents"), F.lit("")
    out = analysed(spark, sf_dir).where(~F.col("is_control"))
    flags = F.filter(F.array(F.when(c % 3 == 0, F.lit("golden_ratio")), F.when(c % 4 == 0, F.lit("circular")), F.when(c % 5 == 0, F.lit("rot90_symmetry"))), lambda x: x.isNotNull())
    return out.select(
        "id", "grp", "angle", "aspect", (c / 5_000_000.0).alias("score"), F.concat(F.lit("Hall "), F.col("cust")).alias("name"), signals.century(1650 + F.col("cust") % 400).alias("century"),
        F.when(c % 7 == 0, "National").when(c % 7 == 1, "Regional").when(c % 7 == 2, "Record Only").otherwise(none).alias("rating"), F.when(c % 2 == 0, "church").otherwise("hall").alias("kind"),
        (F.col("cust") % 26).cast("string").alias("county"), F.when(c % 11 == 0, "accepted").when(c % 11 == 1, "rejected").otherwise(none).alias("review"), flags.alias("flags"), (F.col("cust") % 10).alias("deprivation"),
    )


_REPORT = f"""(SELECT *, cents / 5000000.0::DOUBLE AS score, 'Hall ' || cust AS name, CASE WHEN y < 1700 THEN 'pre-18th' WHEN y >= 2000 THEN '21st' ELSE (y // 100 + 1) || 'th' END AS century,
    CASE cents % 7 WHEN 0 THEN 'National' WHEN 1 THEN 'Regional' WHEN 2 THEN 'Record Only' ELSE '' END AS rating, CASE WHEN cents % 2 = 0 THEN 'church' ELSE 'hall' END AS kind, CAST(cust % 26 AS VARCHAR) AS county,
    CASE cents % 11 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE '' END AS review, list_filter([CASE WHEN cents % 3 = 0 THEN 'golden_ratio' END, CASE WHEN cents % 4 = 0 THEN 'circular' END, CASE WHEN cents % 5 = 0 THEN 'rot90_symmetry' END], lambda x: x IS NOT NULL) AS flags,
    cust % 10 AS deprivation, abs(aspect - 1.618033988749895) / 1.618033988749895 * 100 AS golden_err FROM (SELECT *, 1650 + cust % 400 AS y FROM {ROWS} WHERE NOT is_control))"""

#: Sets of filters, as a report's address would name them, and the same in SQL.
FILTERS = {
    "search": (dict(q="hall 12", min_score=2.0), "lower(name) LIKE '%hall 12%' AND score >= 2.0"),
    "place": (dict(group="1-URGENT", county="7", century="18th"), "grp = '1-URGENT' AND county = '7' AND century = '18th'"),
    "kind": (dict(kind="church", rating="National", review="accepted"), "kind = 'church' AND rating = 'National' AND review = 'accepted'"),
    "pattern": (dict(pattern="golden_ratio", multi=2), "list_contains(flags, 'golden_ratio') AND len(flags) >= 2"),
    "shape": (dict(angle=True, ratio=3.0), "abs(angle - 137.50776405003785) <= 3 AND golden_err <= 3.0"),
    "circular": (dict(circular=True, review="none"), "list_contains(flags, 'circular') AND review = ''"),
    "named": (dict(culture="named"), "trim(name) <> ''"),
    "heritage": (dict(culture="heritage"), "rating IN ('National', 'Regional', 'International')"),
    "pobal": (dict(culture="pobal"), "deprivation >= 7"),
    "civic": (dict(culture="civic", min_score=1.0), "grp IN ('1-URGENT', '2-HIGH') AND score >= 1.0"),
    "all": (dict(), "true"),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS filter, count(*) AS n, CAST(coalesce(sum(id), 0) AS BIGINT) AS ids FROM {_REPORT} WHERE {sql}" for name, (_, sql) in FILTERS.items()))
def report_filter_sets(spark, sf_dir):
    """Rows that each set of filters leaves, all sets in one pass."""
    tests = {name: select.report_filter(civic=["1-URGENT", "2-HIGH"], **how) for name, (how, _) in FILTERS.items()}
    long = rows(spark, sf_dir).select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), t.alias("hit")) for n, t in tests.items()))).alias("x"))
    return long.groupBy("x.filter").agg(F.count_if("x.hit").alias("n"), F.coalesce(F.sum(F.when(F.col("x.hit"), F.col("id"))), F.lit(0)).alias("ids"))


_RATED = f"(SELECT signal, hit, is_control, CASE WHEN cents % 7 < 2 THEN 'high' ELSE 'other' END AS rating, cents % 12 AS kind, cust FROM {LONG})"


@query(f"SELECT signal, count(*) FILTER (rating = 'high' AND hit) AS k1, count(*) FILTER (rating = 'high') AS n1, count(*) FILTER (rating = 'other' AND hit) AS k2, count(*) FILTER (rating = 'other') AS n2 FROM {_RATED} WHERE NOT is_control GROUP BY signal")
def rating_rates(spark, sf_dir):
    """Signals of highly rated targets against all others."""
    long = rates.long_signals(analysed(spark, sf_dir).where(~F.col("is_control")), signals.PRIMARY)
    return rates.both_sides(long.select("signal", "hit", (F.col("cents") % 7 >= 2).alias("is_control")), ["signal"])


@query(f"SELECT kind, signal, count(*) FILTER (hit) AS k, count(*) AS n, count(*) FILTER (hit) / count(*)::DOUBLE AS rate FROM {_RATED} WHERE NOT is_control GROUP BY ALL HAVING count(*) >= 50")
def type_rates(spark, sf_dir):
    """Signals by type, of types with 50 rows or more."""
    long = rates.long_signals(analysed(spark, sf_dir).where(~F.col("is_control")), signals.PRIMARY)
    out = long.groupBy((F.col("cents") % 12).alias("kind"), "signal").agg(F.count_if("hit").alias("k"), F.count(F.lit(1)).alias("n")).where("n >= 50")
    return out.withColumn("rate", stats.rate(F.col("k"), F.col("n")))


@query(
    f"""SELECT signal, k1, n1, k2, n2, round((k1 / n1::DOUBLE - k2 / n2::DOUBLE) / sqrt((k1 + k2) / (n1 + n2)::DOUBLE * (1 - (k1 + k2) / (n1 + n2)::DOUBLE) * (1 / n1::DOUBLE + 1 / n2::DOUBLE)), 9) AS z FROM (
    SELECT signal, count(*) FILTER (cust % 3 <> 0 AND hit) AS k1, count(*) FILTER (cust % 3 <> 0) AS n1, count(*) FILTER (cust % 3 = 0 AND hit) AS k2, count(*) FILTER (cust % 3 = 0) AS n2 FROM {_RATED} WHERE NOT is_control GROUP BY signal)"""
)
def named_against_anonymous(spark, sf_dir):
    """Signals of targets with a known designer against those without."""
    long = rates.long_signals(analysed(spark, sf_dir).where(~F.col("is_control")), signals.PRIMARY)
    out = rates.both_sides(long.select("signal", "hit", (F.col("cust") % 3 == 0).alias("is_control")), ["signal"])
    return out.withColumn("z", F.round(stats.pooled_z(*(F.col(c) for c in ("k1", "n1", "k2", "n2"))), 9))


@query(
    """SELECT p.p_partkey AS id, j.reg_no, 'Designer ' || CAST(o.o_custkey % 50 AS VARCHAR) AS designer, CASE WHEN o.o_custkey % 4 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM (
    SELECT l_orderkey AS reg_no, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY l_orderkey) j JOIN part p ON p.p_partkey = j.part JOIN orders o ON o.o_orderkey = j.reg_no WHERE o.o_orderstatus <> 'F'"""
)
def attribution_join(spark, sf_dir):
    """Register entry to designer and to entity: the last match of an entry counts, and controls are left out."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("reg_no")).agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("id"))
    named = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    named = named.select(F.col("o_orderkey").alias("reg_no"), F.concat(F.lit("Designer "), F.col("o_custkey") % 50).alias("designer"), F.when(F.col("o_custkey") % 4 == 0, "medium").otherwise("high").alias("confidence"))
    return lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "id").join(named, "reg_no").select("id", "reg_no", "designer", "confidence")


_ENTITY = """(SELECT p.p_partkey AS id, p.p_retailprice % 100 AS score, p.p_size % 4 = 0 AS angle, CASE WHEN p.p_size % 3 = 0 THEN p.p_size END AS reg_no, CASE WHEN p.p_size % 6 = 0 THEN 'near' ELSE 'inside' END AS mode, CASE WHEN p.p_size % 9 = 0 THEN 'Designer' END AS designer,
    p.p_size % 5 = 0 AS heritage, p.p_size % 11 = 0 AS has_ref, p.p_size % 22 = 0 AS verified, p.p_size % 13 = 0 AS repaired, p.p_size % 17 = 0 AS multipart FROM part p)"""


@query(
    f"""SELECT id, CASE WHEN has_ref AND verified THEN 'independent_reference' WHEN has_ref THEN 'curated_reference_unverified' WHEN designer IS NOT NULL THEN 'inventory_and_architect_evidence' WHEN reg_no IS NOT NULL THEN 'inventory_matched' WHEN heritage THEN 'osm_heritage_tagged' ELSE 'manual_review_required' END AS status,
    CASE WHEN score >= 75 OR (score >= 55 AND angle AND reg_no IS NOT NULL) THEN 'high' WHEN score >= 55 OR reg_no IS NOT NULL THEN 'medium' ELSE 'low' END AS priority,
    concat_ws('; ', CASE WHEN reg_no IS NOT NULL THEN 'NIAH inventory match' END, CASE WHEN designer IS NOT NULL THEN 'NIAH architect evidence' END, CASE WHEN heritage THEN 'OSM heritage metadata' END, CASE WHEN has_ref THEN 'archival evidence' END) AS sources,
    concat_ws('; ', CASE WHEN reg_no IS NULL THEN 'no NIAH match' END, CASE WHEN reg_no IS NOT NULL AND mode = 'near' THEN 'NIAH match is nearest-point fallback' END, CASE WHEN designer IS NULL THEN 'no architect attribution extracted' END, CASE WHEN NOT has_ref THEN 'no independent reference supplied' END,
    CASE WHEN repaired THEN 'geometry repaired' END, CASE WHEN multipart THEN 'multipart footprint' END) AS warnings FROM {_ENTITY}"""
)
def evidence_records(spark, sf_dir):
    """Evidence status, review priority, sources and warnings of every entity."""
    s, yes = F.col("p_size"), lambda n: F.col("p_size") % n == 0
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_retailprice") % 100).alias("score"), yes(4).alias("angle"), F.when(yes(3), s).alias("reg_no"), F.when(yes(6), "near").otherwise("inside").alias("mode"),
        F.when(yes(9), "Designer").alias("designer"), yes(5).alias("heritage"), yes(11).alias("has_ref"), yes(22).alias("verified"), yes(13).alias("repaired"), yes(17).alias("multipart"),
    )
    return p.select("id", quality.evidence_status().alias("status"), quality.review_priority().alias("priority"), quality.evidence_sources().alias("sources"), quality.evidence_warnings().alias("warnings"))


# tags of edges made from parts, the needs of a vehicle, and the same limits in SQL
VEHICLE = {"weight": 12.0, "rating": 18.0, "height": 3.8, "width": 2.5, "length": 11.0, "axle": 9.0}
_LIMITS = """(SELECT p_partkey AS id, p_size AS s, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN p_size >= 12 ELSE true END AS weight, CASE p_size % 4 WHEN 0 THEN false WHEN 1 THEN p_size >= 18 ELSE true END AS rating,
    CASE p_size % 5 WHEN 0 THEN p_size / 10.0 >= 3.8 WHEN 1 THEN false ELSE true END AS height, CASE p_size % 6 WHEN 0 THEN p_size / 8.0 >= 2.5 ELSE true END AS width, CASE p_size % 7 WHEN 0 THEN p_size >= 11 ELSE true END AS length, CASE p_size % 8 WHEN 0 THEN p_size >= 9 ELSE true END AS axle FROM part)"""


@query(f"SELECT id, weight, rating, height, width, length, axle, weight AND rating AND height AND width AND length AND axle AS passes FROM {_LIMITS}")
def vehicle_filter(spark, sf_dir):
    """Edges that a vehicle may take by all of its limits; what cannot be read closes an edge."""
    s = F.col("p_size")
    text = lambda n, value, other="": F.when(s % n == 0, value).when(s % n == 1, other).otherwise("")
    tags = {
        "weight": text(3, F.lit("none"), F.concat(s, F.lit(" t"))), "rating": F.array(text(4, F.lit("no"), s.cast("string")), text(4, F.lit("40"), F.lit("unlimited"))), "height": text(5, (s / 10.0).cast("string"), F.lit("default")),
        "width": text(6, F.concat(s / 8.0, F.lit(" m"))), "length": text(7, s.cast("string")), "axle": text(8, F.concat(s, F.lit("t"))),
    }
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(c.alias(n) for n, c in tags.items()))
    read = {
        "weight": limits.weight(F.col("weight")), "rating": limits.rating(F.col("rating")[0], F.col("rating")[1]), "height": limits.height(F.col("height")),
        "width": limits.dimension(F.col("width")), "length": limits.dimension(F.col("length")), "axle": limits.weight(F.col("axle")),
    }
    out = e.select("id", *(limits.passes(x, VEHICLE[n]).alias(n) for n, x in read.items()))
    whole = F.lit(True)
    for n in read:
        whole = whole & F.col(n)
    return out.withColumn("passes", whole)


@query(
    """SELECT id, access, CASE WHEN s % 4 = 0 THEN 'maxweight' WHEN s % 4 = 1 THEN NULL ELSE NULL END AS exception, s % 4 = 2 AS unsupported FROM (SELECT p_partkey AS id, p_size AS s, p_size % 3 = 0 AS access FROM part)"""
)
def destination_rules(spark, sf_dir):
    """Ways for heavy vehicles that end there only, and limits that do not hold for these."""
    s = F.col("p_size")
    hgv = F.when(s % 3 == 0, " Destination ").otherwise("yes")
    text = F.when(s % 4 == 0, "none @ (destination); 7.5 @ (Mo-Fr 08:00-18:00)").when(s % 4 == 1, "7.5 @ (weight>7.5)").when(s % 4 == 2, "10 @ destination").otherwise("")
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rules.destination(hgv, text).alias("d"))
    return e.select("id", "d.access", F.when(F.col("d.exception"), F.lit("maxweight")).alias("exception"), "d.unsupported")


@query(
    """SELECT p_partkey AS id, (p_type LIKE '%BRASS' OR p_size < 5 OR p_brand = 'Brand#11' OR p_size > 45) AS wanted, NOT (p_type LIKE '%BRASS' OR p_size < 5 OR p_brand = 'Brand#11' OR p_size > 45) AS control FROM part"""
)
def wanted_tags(spark, sf_dir):
    """Entities to be studied, and ordinary ones that can be controls."""
    p = table(spark, sf_dir, "part")
    building = F.when(F.col("p_type").like("%BRASS"), "church").when(F.col("p_size") < 5, "courthouse").otherwise("yes")
    tags = F.create_map(F.lit("building"), building, F.lit("office"), F.when(F.col("p_brand") == "Brand#11", "government").otherwise(""), F.lit("historic"), F.when(F.col("p_size") > 45, "ruin").otherwise(""))
    t = p.select(F.col("p_partkey").alias("id"), tags.alias("tags"))
    return t.select("id", signals.wanted(F.col("tags")).alias("wanted"), signals.is_control(F.col("tags")).alias("control"))


@query(
    """SELECT 'rows' AS check_, count(*) AS n FROM labels UNION ALL SELECT 'duplicate', count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1) UNION ALL SELECT 'blank', count(*) FROM labels WHERE doc_id IS NULL
    UNION ALL SELECT 'not_allowed', count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0) UNION ALL SELECT 'unknown', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
)
def label_checks(spark, sf_dir):
    """What a strict reader of review labels would refuse: repeated, blank and unknown keys, values that are not allowed (toxic ones, here)."""
    return quality.label_checks(table(spark, sf_dir, "labels"), "doc_id", {"quality": [0, 1], "toxic": [0]}, table(spark, sf_dir, "documents").select("doc_id"))


@query("SELECT count(*) AS n, count(DISTINCT n_nationkey) AS nations, count(DISTINCT n_regionkey) AS regions, count(DISTINCT c_mktsegment) AS segments FROM customer JOIN nation ON n_nationkey = c_nationkey")
def covariate_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("n_nationkey").alias("nations"), F.countDistinct("n_regionkey").alias("regions"), F.countDistinct("c_mktsegment").alias("segments"))


@query(
    """SELECT cx, cy, n, round(0.25 * 110.54 * 0.25 * 111.32 * cos(radians(53 + (cy + 0.5) * 0.25)), 6) AS km2, round(n / (0.25 * 110.54 * 0.25 * 111.32 * cos(radians(53 + (cy + 0.5) * 0.25))), 6) AS density FROM (
    SELECT CAST(floor(embedding[1]::DOUBLE / 0.25) AS BIGINT) AS cx, CAST(floor(embedding[2]::DOUBLE / 0.25) AS BIGINT) AS cy, count(*) AS n FROM embeddings GROUP BY ALL)"""
)
def cell_density(spark, sf_dir):
    """Area in square kilometres and density of each grid cell of a quarter degree."""
    e = table(spark, sf_dir, "embeddings").select(geo.cell(F.col("embedding")[0].cast("double"), 0.25).alias("cx"), geo.cell(F.col("embedding")[1].cast("double"), 0.25).alias("cy"))
    km2 = geo.cell_area(53 + (F.col("cy") + 0.5) * 0.25, 0.25)
    return e.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).select("cx", "cy", "n", F.round(km2, 6).alias("km2"), F.round(F.col("n") / km2, 6).alias("density"))


@query(f"SELECT grp, unnest(['n', 'mean_aspect', 'most_angle']) AS metric, unnest([count(*)::DOUBLE, round(avg(aspect), 6), max(angle)]) AS value FROM {ROWS} GROUP BY grp")
def transposed_metrics(spark, sf_dir):
    """A row for each metric of a group."""
    out = analysed(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("aspect"), 6).alias("mean_aspect"), F.max("angle").alias("most_angle"))
    return out.unpivot(["grp"], ["n", "mean_aspect", "most_angle"], "metric", "value")


@query(
    """SELECT c.c_custkey AS id, CASE WHEN s.n IS NULL THEN 'not_covered' WHEN s.valid = 0 THEN 'unreadable' WHEN s.valid < s.n THEN 'partial' ELSE 'available' END AS status, coalesce(s.valid, 0) AS valid, round(s.highest, 3) AS highest FROM customer c
    LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (value > 20) AS valid, max(value) FILTER (value > 20) AS highest FROM events WHERE event_type <> 'view' GROUP BY user_id) s ON s.user_id = c.c_custkey"""
)
def coverage_rows(spark, sf_dir):
    """Height samples of each entity with an explicit status, also of those without any."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("id"), F.when(F.col("value") > 20, F.col("value")).alias("height"))
    return quality.coverage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), e, "id", "height")


@query(
    """SELECT event_id, CASE u WHEN 0 THEN least(CASE WHEN wd < 5 THEN CASE WHEN m < 480 THEN d + INTERVAL 8 HOUR WHEN m < 1080 THEN t END END, CASE WHEN wd < 4 THEN d + INTERVAL 32 HOUR WHEN wd = 4 THEN d + INTERVAL 80 HOUR WHEN wd = 5 THEN d + INTERVAL 56 HOUR ELSE d + INTERVAL 32 HOUR END)
    WHEN 1 THEN CASE WHEN month(d) BETWEEN 6 AND 8 THEN CASE WHEN m < 600 THEN d + INTERVAL 10 HOUR WHEN m < 960 THEN t WHEN month(d + INTERVAL 1 DAY) <= 8 THEN d + INTERVAL 34 HOUR ELSE make_timestamp(year(d) + 1, 6, 1, 10, 0, 0.0) END WHEN month(d) < 6 THEN make_timestamp(year(d), 6, 1, 10, 0, 0.0) ELSE make_timestamp(year(d) + 1, 6, 1, 10, 0, 0.0) END END AS opens
    FROM (SELECT event_id, user_id % 3 AS u, ts AS t, date_trunc('day', ts) AS d, hour(ts) * 60 + minute(ts) AS m, isodow(ts) - 1 AS wd FROM events)"""
)
def next_opening(spark, sf_dir):
    """When each schedule is open next, from now on: weekly hours, a season, and none."""
    u = F.col("user_id") % 3
    text = F.when(u == 0, "Mo-Fr 08:00-18:00").when(u == 1, "Jun-Aug Mo-Su 10:00-16:00").otherwise("by appointment")
    e = schedule.next_active(table(spark, sf_dir, "events").withColumn("hours", text), "hours", "ts", "opens")
    return e.select("event_id", F.col("opens").cast("timestamp_ntz").alias("opens"))


@query(
    """SELECT event_id, CASE WHEN date_trunc('day', ts) = (SELECT min(date_trunc('day', ts)) FROM events) AND hour(ts) BETWEEN 10 AND 11 THEN true WHEN month(ts) = 12 AND day(ts) = 25 THEN false ELSE isodow(ts) <= 5 AND hour(ts) BETWEEN 8 AND 17 END AS active FROM events"""
)
def holiday_hours(spark, sf_dir):
    """Hours of public holidays add to those of the week; the first day of the events is one."""
    e = table(spark, sf_dir, "events")
    day = e.agg(F.to_date(F.min("ts")).alias("holiday"))
    e = schedule.parse_column(e.withColumn("hours", F.lit("Mo-Fr 08:00-18:00; PH 10:00-12:00; Dec 25 off")), "hours").crossJoin(day)  # one row
    return e.select("event_id", schedule.active_at(F.col("schedule"), F.col("ts"), F.to_date("ts") == F.col("holiday")).alias("active"))


@query(
    f"""SELECT id, concat_ws(',', CASE WHEN golden THEN 'golden_ratio' END, CASE WHEN fib AND near <> 1 THEN 'fib_ratio' END, CASE WHEN dim THEN 'fib_dimension' END, CASE WHEN reflect >= 0.85 THEN 'reflective_symmetry' END, CASE WHEN rot180 >= 0.85 THEN 'rot180_symmetry' END, CASE WHEN rot90 >= 0.85 THEN 'rot90_symmetry' END,
    CASE WHEN rot60 >= 0.85 THEN 'hexagonal' END, CASE WHEN rot45 >= 0.85 THEN 'octagonal' END, CASE WHEN rot72 >= 0.85 THEN 'pentagonal' END, CASE WHEN circ >= 0.85 THEN 'circular' END, CASE WHEN convex <= 0.97 AND vertices >= 8 AND area >= 200 THEN 'cruciform_candidate' END, CASE WHEN golden_angle THEN 'golden_angle' END,
    CASE WHEN right_ >= 0.5 AND vertices >= 4 THEN 'orthogonal' END) AS flags FROM (SELECT id, golden_ratio AS golden, golden_angle, fib_ratio AS fib, list_min(list_transform(range(1, 15), lambda i: {{'err': abs(aspect - {FIB}[i]) / {FIB}[i] * 100, 'i': i}})).i AS near,
    list_bool_or(list_transform([5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610], lambda f: abs(cents % 70000 / 100.0::DOUBLE - f) / f::DOUBLE * 100 <= 3)) AS dim, cents % 101 / 100.0::DOUBLE AS reflect, cents % 103 / 102.0::DOUBLE AS rot180, cents % 107 / 106.0::DOUBLE AS rot90, cents % 109 / 108.0::DOUBLE AS rot60, cents % 113 / 112.0::DOUBLE AS rot45,
    cents % 127 / 126.0::DOUBLE AS rot72, cents % 131 / 130.0::DOUBLE AS circ, cents % 137 / 136.0::DOUBLE AS convex, cents % 15 AS vertices, cents % 401 AS area, cents % 149 / 148.0::DOUBLE AS right_ FROM (SELECT *, abs(angle - 137.50776405003785) <= 3 AS golden_angle, abs(aspect - 1.618033988749895) / 1.618033988749895 * 100 <= 3 AS golden_ratio,
    list_min(list_transform({FIB}, lambda f: abs(aspect - f) / f * 100)) <= 2 AS fib_ratio FROM {ROWS}))"""
)
def all_flags(spark, sf_dir):
    """Every flag of a shape, each from columns of its own."""
    c = F.col("cents")
    share = lambda n: c % n / float(n - 1)
    shape = {
        "aspect": F.col("aspect"), "golden_angle": signals.golden_angle(F.col("angle")), "length_m": c % 70000 / 100.0, "width_m": F.lit(0.0), "reflect": share(101), "rot180": share(103), "rot90": share(107), "rot60": share(109),
        "rot45": share(113), "rot72": share(127), "circularity": share(131), "convexity": share(137), "vertices": c % 15, "area_m2": c % 401, "right_fraction": share(149),
    }
    return analysed(spark, sf_dir).select("id", signals.flags(shape).alias("flags"))
