"""Values parsed from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import evidence, limits, schedule, signals
from fathomline.plans.registry import query, table


@query(
    """SELECT id, y, CASE WHEN y IS NULL THEN NULL WHEN abs(y - y2) > 500 THEN y::DOUBLE ELSE coalesce((y + y2) / 2.0::DOUBLE, y::DOUBLE) END AS mid, (y // 50 * 50) || '-' || (y // 50 * 50 + 49) AS half FROM (
    SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 1800 + o_orderkey % 150 WHEN 2 THEN 1900 + o_orderkey % 90 WHEN 3 THEN 950 ELSE NULL END AS y, CASE WHEN o_orderkey % 2 = 0 THEN 1850 + o_orderkey % 100 ELSE NULL END AS y2 FROM orders)"""
)
def year_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("c. "), 1800 + k % 150)).when(k % 5 == 2, F.concat(F.lit("1"), 1900 + k % 90)).when(k % 5 == 3, "950").otherwise("undated")
    y = limits.year(text)
    y2 = F.when(k % 2 == 0, 1850 + k % 100)
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), y.alias("y"), y2.alias("y2"))
    return rows.select("id", "y", F.when(F.col("y").isNotNull(), limits.mid_year(F.col("y"), F.col("y2"))).alias("mid"), signals.half_century(F.col("y")).alias("half"))


_KINDS = "(SELECT p_partkey AS id, p_size AS s FROM part)"


@query(
    f"""SELECT id, CASE s % 4 WHEN 0 THEN s / 10.0::DOUBLE WHEN 1 THEN s::DOUBLE / 100.0 WHEN 2 THEN (s % 12) * 0.3048::DOUBLE + 6.0::DOUBLE * 0.0254::DOUBLE END AS height,
    CASE s % 3 WHEN 0 THEN s::DOUBLE * 1.609344::DOUBLE WHEN 1 THEN s::DOUBLE END AS speed, CASE s % 3 WHEN 0 THEN s * 3600.0::DOUBLE + 900 WHEN 1 THEN s * 60.0::DOUBLE + 30 END AS seconds FROM {_KINDS}"""
)
def limit_values(spark, sf_dir):
    s = F.col("p_size")
    t = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    high = F.when(s % 4 == 0, (s / 10.0).cast("string")).when(s % 4 == 1, t(s, " cm")).when(s % 4 == 2, t(s % 12, "'6\"")).otherwise("default")
    fast = F.when(s % 3 == 0, t(s, " mph")).when(s % 3 == 1, t(s, "")).otherwise("walk")
    long = F.when(s % 3 == 0, t(s, ":15")).when(s % 3 == 1, t(s, " min 30s")).otherwise("a while")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), high.alias("h"), fast.alias("f"), long.alias("d"))
    return rows.select("id", limits.height(F.col("h"))["value"].alias("height"), limits.speed(F.col("f"))["value"].alias("speed"), limits.duration(F.col("d")).alias("seconds"))


@query(f"SELECT id, CASE s % 3 WHEN 0 THEN '>' WHEN 1 THEN '<=' END AS op, CASE s % 3 WHEN 0 THEN s + 0.5::DOUBLE WHEN 1 THEN s::DOUBLE END AS tonnes, CASE s % 3 WHEN 2 THEN 'no_left_turn' END AS kind FROM {_KINDS}")
def conditions(spark, sf_dir):
    s = F.col("p_size")
    text = F.when(s % 3 == 0, F.concat(F.lit("(weight > "), s, F.lit(".5 t)"))).when(s % 3 == 1, F.concat(F.lit("weight<="), s)).otherwise("no_left_turn @ (Mo-Fr 07:00-09:00)")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), limits.weight_condition(text).alias("w"), limits.turn_condition(text).alias("t"))
    return rows.select("id", F.col("w.op").alias("op"), F.col("w.tonnes").alias("tonnes"), F.col("t.kind").alias("kind"))


@query(
    """SELECT event_id, CASE user_id % 4 WHEN 0 THEN (dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) BETWEEN 8 AND 17 OR dayofweek(ts) = 6 AND hour(ts) BETWEEN 9 AND 11) WHEN 1 THEN hour(ts) >= 22 OR hour(ts) < 4
    WHEN 2 THEN month(ts) <> 1 OR day(ts) <> 6 ELSE false END AS active FROM events"""
)
def opening_hours(spark, sf_dir):
    u = F.col("user_id") % 4
    text = F.when(u == 0, "Mo-Fr 08:00-18:00; Sa 09:00-12:00").when(u == 1, "Mo-Su 22:00-04:00").when(u == 2, "24/7; Jan 6 off").otherwise("by appointment")
    rows = schedule.parse_column(table(spark, sf_dir, "events").withColumn("hours", text), "hours")
    return rows.select("event_id", schedule.active_at(F.col("schedule"), F.col("ts")).alias("active"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\bthe\\b')) AS wanted, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents")
def regex_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit(r"\bthe\b")).cast("long").alias("wanted"), F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"))


#: Sentences of an appraisal, with the name and confidence that they give.
SENTENCES = [
    ("Detached hall, built to designs by the architect J.J. Moss of Cork.", "J.J. Moss", "high"),
    ("Terraced house, designed by Ada Brook and Sons. Restored later.", "Ada Brook", "high"),
    ("The plans of the whole terrace, long lost, were prepared by James Joseph Moss (1844-1917).", "James Joseph Moss", "high"),
    ("Stained glass window designed by Harry Lane.", None, None),
    ("To a design signed by the Parochial Board.", None, None),
    ("An architectural, by Mary Ann Wells, for a bank.", "Mary Ann Wells", "medium"),
    ("A plain barn.", None, None),
    ("Altar designed by Harry Lane; hall works executed by engineer Tom Reed.", "Tom Reed", "high"),
]
_SAID = "(SELECT * FROM (VALUES " + ", ".join("({}, {}, {}, {})".format(i, *("NULL" if v is None else f"'{v}'" for v in (name, how, None if name is None else {"J.J. Moss": "Moss JJ", "Ada Brook": "Brook A", "James Joseph Moss": "Moss JJ", "Mary Ann Wells": "Wells MA", "Tom Reed": "Reed T"}[name]))) for i, (_, name, how) in enumerate(SENTENCES)) + ") v(i, name, confidence, key))"


@query(f"SELECT c_custkey AS id, name, confidence, key FROM customer JOIN {_SAID} ON i = c_custkey % {len(SENTENCES)} WHERE name IS NOT NULL")
def attributions(spark, sf_dir):
    """Designers named in appraisals, by patterns of falling confidence, and the keys that spellings of one name share."""
    said = F.element_at(F.array(*(F.lit(x) for x, _, _ in SENTENCES)), (F.col("c_custkey") % len(SENTENCES) + 1).cast("int"))
    text = F.concat(F.lit("Entry "), F.col("c_custkey").cast("string"), F.lit(". "), said)
    found = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), evidence.attribution(text).alias("a")).where("a IS NOT NULL")
    return found.select("id", "a.name", "a.confidence", evidence.name_key(F.col("a.name")).alias("key"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'x' ELSE coalesce(nullif(trim(p_brand), ''), '') END AS first, p_size % 3 = 0 AS yes FROM part")
def properties(spark, sf_dir):
    s = F.col("p_size")
    props = F.create_map(F.lit("name"), F.when(s % 5 == 0, " x ").otherwise(" "), F.lit("brand"), F.col("p_brand"))
    yes = F.when(s % 3 == 0, " Yes ").when(s % 3 == 1, "no")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), limits.first_of(props, "name", "brand").alias("first"), limits.truthy(yes).alias("yes"))


@query(f"SELECT id, CASE s % 4 WHEN 0 THEN 'van' WHEN 1 THEN 'lorry' END AS name, CASE s % 4 WHEN 0 THEN 3.5::DOUBLE WHEN 1 THEN s::DOUBLE + 1 END AS weight, CASE s % 4 WHEN 1 THEN 3.8::DOUBLE END AS height, s % 4 < 2 AS ok FROM {_KINDS}")
def profile_specs(spark, sf_dir):
    """Vehicles as texts: a name and its needs; unknown keys and values that are no numbers above 0 are refused."""
    s = F.col("p_size")
    text = F.when(s % 4 == 0, "van; weight=3.5").when(s % 4 == 1, F.concat(F.lit("lorry;weight="), s + 1, F.lit(";height = 3.8;"))).when(s % 4 == 2, "bus;seats=50").otherwise("cart;weight=-1")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), limits.profile(text).alias("p"))
    need = lambda n: F.try_element_at("p.needs", F.lit(n)).alias(n)
    return rows.select("id", "p.name", need("weight"), need("height"), "p.ok")
