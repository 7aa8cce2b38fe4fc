"""Statistics of proportions as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Quantile of the normal distribution for 95 %, least p-value reported, verdict limits.
Z95 = 1.959963984540054
MIN_P = 1e-300
SIGNAL_ALPHA, SUGGESTIVE_ALPHA = 0.01, 0.05


def rate(k: Column, n: Column) -> Column:
    """k / n, 0 if n is 0."""
    return F.when(n > 0, k / n).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval at 95 %; (0, 1) if n is 0."""
    p, z2 = k / n, Z95 * Z95
    denom = 1 + F.lit(z2) / n
    centre = (p + F.lit(z2) / (2 * n)) / denom
    half = F.lit(Z95) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n)) / denom
    return (
        F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0)),
        F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(1.0)),
    )


def odds_ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Odds ratio with half a case added to every cell."""
    zero = F.lit(0)
    return ((k1 + 0.5) * (F.greatest(zero, n2 - k2) + 0.5)) / ((F.greatest(zero, n1 - k1) + 0.5) * (k2 + 0.5))


def pooled_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two-proportion z with pooled variance; 0 where it is not defined."""
    pooled = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    ok = (n1 > 0) & (n2 > 0) & (pooled > 0) & (pooled < 1)
    return F.when(ok, (k1 / n1 - k2 / n2) / se).otherwise(F.lit(0.0))


def unpooled_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two-proportion z with each side's own variance; 0 where it is not defined."""
    p1, p2 = k1 / n1, k2 / n2
    se = F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return F.when((n1 > 0) & (n2 > 0) & (se > 0), (p1 - p2) / se).otherwise(F.lit(0.0))


def two_sided_p(z: str) -> Column:
    """p-value of the absolute value of a column; Spark has no erfc, and this runs on aggregated rows only."""
    return F.pandas_udf(_erfc_p, "double")(z)


def _erfc_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: max(MIN_P, math.erfc(abs(x) / math.sqrt(2.0))))


def holm(df: DataFrame, p: str, family: list[str], name: str = "p_adjusted") -> DataFrame:
    """Add Holm-adjusted p-values within each family.

    Equal values have one result, so values are counted before they are put in order:
    a task orders the distinct values of a family.
    """
    counts = df.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*family).orderBy(p).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum("_n").over(Window.partitionBy(*family)) - F.sum("_n").over(upto) + F.col("_n")  # those from this value on
    value = F.least(F.lit(1.0), F.greatest(F.lit(MIN_P), F.col(p)))
    counts = counts.withColumn("_s", left * value).withColumn(name, F.least(F.lit(1.0), F.max("_s").over(upto)))
    other = counts.select(*(F.col(c).alias(f"_{c}") for c in (*family, p)), name)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*family, p)))
    return df.drop(name).join(other, same).select(*(c for c in df.columns if c != name), name)


def verdict(p_adjusted: Column, direction: Column) -> Column:
    up = direction > 0
    return F.when(up & (p_adjusted < SIGNAL_ALPHA), "SIGNAL").when(up & (p_adjusted < SUGGESTIVE_ALPHA), "suggestive").otherwise("background")


def p_text(p: Column) -> Column:
    """A p-value for reading: bounds below a thousandth, else four places without trailing zeros."""
    text = F.rtrim(F.format_string("%.4f", p), F.lit("0"))
    return F.when(p.isNull(), "n/a").when(p < 1e-4, "<0.0001").when(p < 1e-3, "<0.001").otherwise(F.rtrim(text, F.lit(".")))


def random_effects(strata: DataFrame, by: list[str], a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> DataFrame:
    """Pool the log odds ratios of 2x2 tables: fixed effect, Q, tau2 and DerSimonian-Laird random effects.

    One aggregation gives the weighted sums of the fixed effect, a second one, over
    the strata joined with its tau2, the pooled effect.
    """
    aa, bb, cc, dd = (F.col(x) + 0.5 for x in (a, b, c, d))
    rows = strata.withColumn("_e", F.log((aa * dd) / (bb * cc))).withColumn("_v", 1 / aa + 1 / bb + 1 / cc + 1 / dd).withColumn("_w", 1 / F.col("_v"))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_w")).alias("w2"), F.sum(F.col("_w") * F.col("_e")).alias("we"), F.sum(F.col("_w") * F.col("_e") * F.col("_e")).alias("wee")
    )
    fixed = F.col("we") / F.col("w")
    q = F.greatest(F.lit(0.0), F.col("wee") - F.col("we") * fixed)
    denom = F.col("w") - F.col("w2") / F.col("w")
    tau2 = F.when(denom > 0, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / denom)).otherwise(F.lit(0.0))
    first = sums.select(*by, "k", fixed.alias("fixed_log_or"), q.alias("q"), tau2.alias("tau2"))
    weighted = rows.join(first, by).withColumn("_r", 1 / (F.col("_v") + F.col("tau2")))
    out = weighted.groupBy(*by, "k", "fixed_log_or", "q", "tau2").agg((F.sum(F.col("_r") * F.col("_e")) / F.sum("_r")).alias("random_log_or"), F.sqrt(1 / F.sum("_r")).alias("se"))
    low, high = F.col("random_log_or") - Z95 * F.col("se"), F.col("random_log_or") + Z95 * F.col("se")
    return out.withColumn("random_or", F.exp("random_log_or")).withColumn("ci_low", F.exp(low)).withColumn("ci_high", F.exp(high)).withColumn("z", F.when(F.col("se") > 0, F.col("random_log_or") / F.col("se")).otherwise(F.lit(0.0)))


def quantiles(rows: DataFrame, by: list[str], value: str, width: float, at: dict[str, float]) -> DataFrame:
    """For each group the values at index floor(q * n) of its sorted values (the last at most), a column for each name of at.

    Values are counted in ranges of the given width, which tells the range of each
    quantile and its place in that; only the values of these ranges are sorted.
    """
    known = rows.select(*by, F.col(value).alias("_v"), F.floor(F.col(value) / F.lit(float(width))).alias("_b")).where("_v IS NOT NULL")
    counts = known.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    places = F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.col("_n") - 1, F.floor(F.col("_n") * q)).alias("k")) for name, q in at.items()))
    wanted = counts.withColumn("_w", F.explode(places)).where((F.col("_w.k") < F.col("_upto")) & (F.col("_w.k") >= F.col("_upto") - F.col("_c")))
    wanted = wanted.select(*by, "_b", F.col("_w.name").alias("_name"), (F.col("_w.k") - F.col("_upto") + F.col("_c") + 1).alias("_place"))
    met = known.join(wanted, [*by, "_b"])
    met = met.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_name").orderBy("_v"))).where("_i = _place")
    return met.groupBy(*by).pivot("_name", list(at)).agg(F.first("_v"))
