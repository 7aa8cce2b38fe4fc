"""Audits, reviews, histories and dossiers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import quality, select
from fathomline.plans.registry import query, table

_AUDIT = "(SELECT c_mktsegment AS grp, unnest(['c_acctbal', 'c_nationkey', 'c_name']) AS field, unnest([CAST(c_acctbal AS VARCHAR), CAST(c_nationkey AS VARCHAR), c_name]) AS value, unnest([c_acctbal < 0 OR c_acctbal > 9000, c_nationkey < 1 OR c_nationkey > 20, false]) AS bad FROM customer)"


@query(f"SELECT CASE WHEN grouping(grp) = 1 THEN 'all' ELSE grp END AS grp, field, count(*) AS rows, count(*) - count(value) AS missing, count(*) FILTER (bad) AS invalid, count(DISTINCT value) AS distinct_values FROM {_AUDIT} GROUP BY GROUPING SETS ((grp, field), (field))")
def field_audit(spark, sf_dir):
    return quality.field_audit(table(spark, sf_dir, "customer"), "c_mktsegment", {"c_acctbal": (0, 9000), "c_nationkey": (1, 20), "c_name": (None, None)})


@query("SELECT p_size, p_brand, n, id FROM (SELECT p_size, p_brand, p_partkey AS id, count(*) OVER (PARTITION BY p_size, p_brand) AS n FROM part) WHERE n > 1")
def duplicate_groups(spark, sf_dir):
    return quality.duplicate_groups(table(spark, sf_dir, "part"), ["p_size", "p_brand"], "p_partkey")


@query("SELECT array_to_string(list_sort(list(s || '=' || n)), ';') AS distribution FROM (SELECT coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderstatus END), ''), nullif(trim(o_orderpriority), ''), 'available') AS s, count(*) AS n FROM orders GROUP BY 1)")
def status_distribution(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus")))
    return quality.distribution(o.select(quality.status(o, "status", "o_orderpriority").alias("s")), "s")


_JUDGED = "(SELECT d.n_chars AS score, l.quality = 1 AS truth FROM labels l JOIN documents d USING (doc_id))"


@query(
    f"""SELECT *, (SELECT round(avg(pow(least(1.0, score / 10000.0::DOUBLE) - CAST(truth AS INT), 2)), 9) FROM {_JUDGED}) AS brier, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1 FROM (
    SELECT t AS threshold, count(*) FILTER (score >= t AND truth) AS tp, count(*) FILTER (score >= t AND NOT truth) AS fp, count(*) FILTER (score < t AND truth) AS fn, count(*) FILTER (score < t AND NOT truth) AS tn FROM {_JUDGED} CROSS JOIN (VALUES (500.0::DOUBLE), (1000.0::DOUBLE), (2000.0::DOUBLE), (4000.0::DOUBLE), (8000.0::DOUBLE)) v(t) GROUP BY t)"""
)
def calibration(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("truth"))
    return quality.calibration(rows, "score", "truth", [500, 1000, 2000, 4000, 8000], 10000.0).withColumn("brier", F.round("brier", 9))


@query(f"SELECT p AS predicted, a AS actual, (SELECT count(*) FROM {_JUDGED} WHERE CAST(score >= 1000 AS INT) = p AND CAST(truth AS INT) = a) AS n FROM (VALUES (0), (1)) x(p) CROSS JOIN (VALUES (0), (1)) y(a)")
def confusion_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return quality.confusion(rows.select((F.col("n_chars") >= 1000).alias("p"), (F.col("quality") == 1).alias("a")), "p", "a")


_TOKENS = "concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment)"


@query(
    f"""SELECT count(*) AS n, CAST(sum(('0x' || substr(h, 1, 12))::BIGINT) AS VARCHAR) AS low, CAST(sum(('0x' || substr(h, 13, 12))::BIGINT) AS VARCHAR) AS high FROM (SELECT sha256({_TOKENS}) AS h FROM customer)"""
)
def row_digest(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def _kinds_sql(name: str, columns: list[str]) -> str:
    """numeric or string for each column, by its values that are not blank."""
    one = "SELECT {i} AS i, '{c}' AS field, CASE WHEN coalesce(bool_and(try_cast({c}::VARCHAR AS DOUBLE) IS NOT NULL) FILTER (trim({c}::VARCHAR) <> ''), false) THEN 'numeric' ELSE 'string' END AS kind FROM {t}"
    return "(" + " UNION ALL ".join(one.format(i=i, c=c, t=name) for i, c in enumerate(columns)) + ")"


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(f"SELECT field, kind FROM {_kinds_sql('customer', _CUSTOMER)}")
def field_kinds(spark, sf_dir):
    return quality.field_kinds(table(spark, sf_dir, "customer"))


@query(f"SELECT sha256(string_agg(field || ':' || kind, ',' ORDER BY i)) AS fingerprint FROM {_kinds_sql('orders', _ORDERS)}")
def schema_fingerprint(spark, sf_dir):
    return quality.schema_fingerprint(table(spark, sf_dir, "orders"))


@query("SELECT 'numeric:c_name' AS rule, count(*) AS violations FROM customer UNION ALL SELECT 'unique:c_nationkey', count(c_nationkey) - count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'unique:c_custkey', count(c_custkey) - count(DISTINCT c_custkey) FROM customer UNION ALL SELECT 'required:' || c, (SELECT 1 - count(*) FROM (DESCRIBE customer) WHERE column_name = c) FROM (VALUES ('c_name'), ('c_town')) v(c)")
def registry_audit(spark, sf_dir):
    return quality.audit_rules(table(spark, sf_dir, "customer"), ["c_name", "c_town"], ["c_name"], ["c_nationkey", "c_custkey"])


@query(
    """SELECT c.c_custkey AS user_id, h.versions, h.first_edit, h.last_edit, h.age_days, CASE WHEN h.versions IS NULL THEN 'not_provided' ELSE 'available' END AS history_status FROM customer c
    LEFT JOIN (SELECT user_id, count(*) AS versions, min(ts) AS first_edit, max(ts) AS last_edit, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS age_days FROM events GROUP BY user_id) h ON h.user_id = c.c_custkey"""
)
def entity_history(spark, sf_dir):
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return quality.with_history(entities, table(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS large FROM events GROUP BY user_id")
def edit_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("large"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedup_last(spark, sf_dir):
    return quality.last_of(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT event_type, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY event_type")
def first_and_last_of_key(spark, sf_dir):
    order = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("last_id"))


@query(
    """SELECT d.doc_id, row_number() OVER (ORDER BY d.n_chars DESC, d.doc_id) AS rank, coalesce(CAST(l.quality AS VARCHAR), 'not_reviewed') AS label FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.n_chars > 3000"""
)
def candidate_queue(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars > 3000").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    ranked = select.numbered(docs, "rank", 1000.0)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label"))
    return ranked.join(labels, "id", "left").select(F.col("id").alias("doc_id"), "rank", F.coalesce("label", F.lit("not_reviewed")).alias("label"))


@query(
    """SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'not_provided' WHEN l.quality = 1 AND l.toxic = 0 THEN 'verified' ELSE 'disputed' END AS evidence,
    CASE WHEN d.n_chars >= 4000 AND l.quality IS NULL THEN 'high' WHEN d.n_chars >= 1500 THEN 'medium' ELSE 'low' END AS priority,
    concat_ws('; ', CASE WHEN l.quality IS NULL THEN 'no label' END, CASE WHEN d.n_chars < 100 THEN 'short text' END, CASE WHEN l.toxic = 1 THEN 'toxic' END) AS warnings FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def dossiers(spark, sf_dir):
    """A wide record of each entity: evidence status, review priority and warnings."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    none = F.col("quality").isNull()
    evidence = F.when(none, "not_provided").when((F.col("quality") == 1) & (F.col("toxic") == 0), "verified").otherwise("disputed")
    priority = F.when((F.col("n_chars") >= 4000) & none, "high").when(F.col("n_chars") >= 1500, "medium").otherwise("low")
    warnings = F.concat_ws("; ", F.when(none, "no label"), F.when(F.col("n_chars") < 100, "short text"), F.when(F.col("toxic") == 1, "toxic"))
    return d.select("doc_id", evidence.alias("evidence"), priority.alias("priority"), warnings.alias("warnings"))


@query("SELECT 'unknown' AS kind, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'labelled', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def id_checks(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    parts = [("unknown", lab.join(d, "doc_id", "left_anti")), ("unlabelled", d.join(lab, "doc_id", "left_anti")), ("labelled", d.join(lab, "doc_id", "left_semi"))]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE o_totalprice > 300000")
def dimension_joins(spark, sf_dir):
    """Hash joins to dimensions; Spark broadcasts those it measures as small."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return o.join(c, "c_custkey", "left").join(n, "n_nationkey", "left").join(table(spark, sf_dir, "region"), "r_regionkey", "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey AS id, 'account' AS via, c_name AS ref FROM customer JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT c_custkey, 'branch', s_name FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey = c_custkey // 10")
def references_by_two_keys(spark, sf_dir):
    """References found by either of two keys; one found by both is listed twice."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    one = c.join(s, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("id"), F.lit("account").alias("via"), F.col("c_name").alias("ref"))
    two = c.join(s, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_suppkey") == F.floor(F.col("c_custkey") / 10)))
    return one.unionByName(two.select(F.col("c_custkey").alias("id"), F.lit("branch").alias("via"), F.col("s_name").alias("ref")))
