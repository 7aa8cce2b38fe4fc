"""Splits, samples, resampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import signals, stats
from fathomline.operators import rates, sample
from fathomline.plans.rates import _UZ as UNPOOLED
from fathomline.plans.rates import LONG, ROWS, analysed, erfc_sql
from fathomline.plans.registry import query, table

_UNIT = "(('0x' || substr(sha256('split-1:' || id), 1, 12))::BIGINT / pow(16::DOUBLE, 12))"


@query(f"SELECT id, {_UNIT} AS u, {_UNIT} < 0.3 AS is_holdout FROM {ROWS}")
def hash_split(spark, sf_dir):
    return sample.holdout(analysed(spark, sf_dir), "id", "split-1", 0.3).select("id", sample.unit("split-1", F.col("id")).alias("u"), "is_holdout")


@query(f"SELECT id FROM {ROWS} WHERE id % 41 = 0")
def systematic_sample(spark, sf_dir):
    return sample.systematic(analysed(spark, sf_dir), "id", 41).select("id")


@query(f"SELECT id FROM {ROWS} ORDER BY {_UNIT}, id LIMIT 150")
def hash_sample_topn(spark, sf_dir):
    return sample.simple(analysed(spark, sf_dir), "id", "split-1", 150).select("id")


@query(
    f"""SELECT is_holdout, signal, count(*) FILTER (hit AND NOT is_control) AS k1, count(*) FILTER (NOT is_control) AS n1, count(*) FILTER (hit AND is_control) AS k2, count(*) FILTER (is_control) AS n2
    FROM (SELECT *, {_UNIT} < 0.3 AS is_holdout FROM {LONG}) GROUP BY ALL"""
)
def holdout_rates(spark, sf_dir):
    rows = sample.holdout(analysed(spark, sf_dir), "id", "split-1", 0.3)
    return rates.both_sides(rates.long_signals(rows, signals.PRIMARY), ["is_holdout", "signal"])


_HELD = f"(SELECT signal, count(*) FILTER (hit AND NOT is_control) AS k1, count(*) FILTER (NOT is_control) AS n1, count(*) FILTER (hit AND is_control) AS k2, count(*) FILTER (is_control) AS n2 FROM {LONG} WHERE {_UNIT} < 0.3 GROUP BY signal)"


@query(f"SELECT signal, k1, n1, k2, n2, round(z, 9) AS z, round({erfc_sql('z')}, 9) AS p FROM (SELECT *, {UNPOOLED} AS z FROM {_HELD})")
def holdout_evaluation(spark, sf_dir):
    """Unpooled z and p of each signal in the holdout."""
    rows = sample.holdout(analysed(spark, sf_dir), "id", "split-1", 0.3).where("is_holdout")
    out = rates.both_sides(rates.long_signals(rows, signals.PRIMARY), ["signal"])
    out = out.withColumn("z", stats.unpooled_z(*(F.col(c) for c in ("k1", "n1", "k2", "n2"))))
    return out.withColumn("p", stats.two_sided_p("z")).withColumns({c: F.round(c, 9) for c in ("z", "p")})


@query()
def block_bootstrap(spark, sf_dir):
    """Bootstrap over blocks of customers."""
    long = rates.long_signals(analysed(spark, sf_dir), signals.PRIMARY).withColumn("cell", F.floor(F.col("cust") / 25))
    return sample.block_bootstrap(rates.both_sides(long, ["signal", "cell"]), ["signal"])


@query()
def permutation_p(spark, sf_dir):
    """Permutation of target labels within years."""
    rows = analysed(spark, sf_dir).select("id", "year", (~F.col("is_control")).alias("label"), signals.signal("golden_ratio").alias("hit"))
    return sample.permutation(rows, "year", "id", "label", "hit")


@query("SELECT o_custkey AS u, o_orderkey AS v, 'forward' AS kind FROM orders UNION ALL SELECT o_orderkey, o_custkey, 'backward' FROM orders UNION ALL SELECT l_orderkey, l_partkey, 'ferry' FROM lineitem")
def union_edges(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edges = o.select(F.col("o_custkey").alias("u"), F.col("o_orderkey").alias("v"), F.lit("forward").alias("kind"))
    edges = edges.unionByName(o.select(F.col("o_orderkey").alias("u"), F.col("o_custkey").alias("v"), F.lit("backward").alias("kind")))
    return edges.unionByName(li.select(F.col("l_orderkey").alias("u"), F.col("l_partkey").alias("v"), F.lit("ferry").alias("kind")))


@query("SELECT year(o_orderdate) * 100 + month(o_orderdate) AS month FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT year(o_orderdate) * 100 + month(o_orderdate) FROM orders WHERE o_orderstatus = 'P'")
def intersect_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("month", F.year("o_orderdate") * 100 + F.month("o_orderdate"))
    return o.where("o_orderstatus = 'F'").select("month").intersect(o.where("o_orderstatus = 'P'").select("month"))


@query("SELECT 'customers' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'orders', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def except_ids(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey")
    sides = [("customers", c.subtract(o)), ("orders", o.subtract(c))]
    made = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n") for name, d in sides]
    return made[0].unionByName(made[1])
