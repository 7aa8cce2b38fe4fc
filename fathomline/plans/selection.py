"""Bounded, sorted and paged selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.operators import select
from fathomline.plans.registry import query, table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored rows; every seventh has no valid score."""
    score = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), (F.col("o_orderstatus") == "F").alias("is_control"), select.valid_score(score).alias("score")
    )


_SCORED = "(SELECT o_orderkey AS id, o_orderpriority AS grp, o_orderstatus = 'F' AS is_control, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS score FROM orders)"


@query(f"SELECT id, grp, score FROM {_SCORED} WHERE NOT is_control AND score >= 1000 ORDER BY score DESC NULLS LAST, id LIMIT 100 OFFSET 50")
def bounded_query(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return select.bounded(select.matching(rows, is_control=False, min_score=1000.0), limit=100, offset=50).select("id", "grp", "score")


@query(f"SELECT id, score FROM {_SCORED} WHERE score IS NULL OR score < 250000 OR (score = 250000 AND id > 10) ORDER BY score DESC NULLS LAST, id LIMIT 80")
def keyset_page(spark, sf_dir):
    return select.bounded(select.after(_scored(spark, sf_dir), 250000.0, 10), limit=80).select("id", "score")


@query(f"SELECT id FROM {_SCORED} WHERE score IS NULL AND id > 700 ORDER BY id LIMIT 60")
def invalid_score_tail(spark, sf_dir):
    return select.bounded(select.after(_scored(spark, sf_dir), None, 700), limit=60).select("id")


@query(
    f"""WITH page AS (SELECT id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS rn FROM {_SCORED} WHERE grp = '1-URGENT')
    SELECT id, score, (SELECT count(*) > 25 FROM page) AS has_more FROM page WHERE rn <= 25"""
)
def page_has_more(spark, sf_dir):
    return select.page(select.matching(_scored(spark, sf_dir), group="1-URGENT"), 25).select("id", "score", "has_more")


@query(f"SELECT id, grp, score FROM {_SCORED} WHERE score IS NOT NULL ORDER BY grp DESC, id LIMIT 120")
def report_page(spark, sf_dir):
    return select.report_sorted(_scored(spark, sf_dir).where("score IS NOT NULL"), "grp", descending=True).limit(120).select("id", "grp", "score")


@query(f"SELECT id, score FROM {_SCORED} WHERE score >= 400000")
def strong_rows(spark, sf_dir):
    return select.matching(_scored(spark, sf_dir), min_score=400000.0).orderBy(F.desc("score"), "id").select("id", "score")


@query("SELECT DISTINCT o_orderpriority AS value, 'priority' AS field FROM orders UNION ALL SELECT DISTINCT o_orderstatus, 'status' FROM orders")
def filter_options(spark, sf_dir):
    return select.options(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))


_FLAGS = """(SELECT p_partkey AS id, p_retailprice AS score, list_filter([CASE WHEN p_size <= 10 THEN 'small' END, CASE WHEN p_size > 40 THEN 'large' END,
    CASE WHEN p_retailprice >= 1200 THEN 'dear' END, CASE WHEN p_name LIKE '%e%' THEN 'one' END], lambda x: x IS NOT NULL) AS flags FROM part)"""


def _flagged(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    flags = F.array_compact(
        F.array(
            F.when(F.col("p_size") <= 10, F.lit("small")),
            F.when(F.col("p_size") > 40, F.lit("large")),
            F.when(F.col("p_retailprice") >= 1200, F.lit("dear")),
            F.when(F.col("p_name").like("%e%"), F.lit("one")),
        )
    )
    return part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), flags.alias("flags"))


@query(
    f"""SELECT c.flag AS flag, count(f.id) AS n, count(f.id) * 100.0::DOUBLE / (SELECT count(*) FROM part) AS percent
    FROM (VALUES ('small'), ('large'), ('dear'), ('one'), ('never')) c(flag) LEFT JOIN (SELECT id, unnest(flags) AS flag FROM {_FLAGS}) f ON f.flag = c.flag GROUP BY c.flag"""
)
def pattern_catalogue(spark, sf_dir):
    return select.catalogue(_flagged(spark, sf_dir), "flags", ["small", "large", "dear", "one", "never"])


@query(
    f"""WITH f AS (SELECT id, score, flags FROM {_FLAGS}),
    a AS (SELECT id, score, 'dear' AS theme FROM f WHERE list_contains(flags, 'dear') ORDER BY score DESC, id LIMIT 1),
    b AS (SELECT id, score, 'small' AS theme FROM f WHERE list_contains(flags, 'small') AND id NOT IN (SELECT id FROM a) ORDER BY score DESC, id LIMIT 1),
    c AS (SELECT id, score, 'one' AS theme FROM f WHERE list_contains(flags, 'one') AND id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) ORDER BY score DESC, id LIMIT 1)
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""
)
def field_walk(spark, sf_dir):
    return select.walk(_flagged(spark, sf_dir), "flags", ["dear", "small", "one"]).select("id", "score", "theme")


@query(
    f"""SELECT id, score FROM {_SCORED} WHERE NOT is_control AND grp IN ('1-URGENT', '2-HIGH') AND score BETWEEN 100000 AND 200000 AND CAST(id AS VARCHAR) LIKE '%12%'"""
)
def report_filters(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    tests = [~F.col("is_control"), F.col("grp").isin("1-URGENT", "2-HIGH"), F.col("score").between(100000, 200000), F.lower(F.col("id").cast("string")).contains("12")]
    return rows.where(reduce(lambda a, b: a & b, tests)).select("id", "score")


@query(f"SELECT id, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS review_rank FROM {_SCORED} WHERE score > 350000")
def review_queue(spark, sf_dir):
    rows = _scored(spark, sf_dir).where("score > 350000")
    return select.numbered(rows, "review_rank", width=1000.0).select("id", "review_rank")


@query(
    f"""SELECT id, score, grp FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC NULLS LAST, id) AS rn FROM {_SCORED}) WHERE rn <= 3"""
)
def top_of_group(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc_nulls_last("score"), "id"))
    return _scored(spark, sf_dir).withColumn("rn", rank).where("rn <= 3").select("id", "score", "grp")
