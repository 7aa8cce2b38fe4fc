"""Counts of signals in targets and controls.

Rows have grp, is_control and what signals look at. All signals are counted in
one pass: they are columns of one aggregation or one explode, never one scan each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Signals = dict[str, Callable[[], Column]]


def long_signals(rows: DataFrame, signals: Signals) -> DataFrame:
    """A row for each row and signal: signal, hit. A signal that is null is no hit."""
    made = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.coalesce(f(), F.lit(False)).alias("hit")) for n, f in signals.items())))
    return rows.withColumn("_x", made).select(*rows.columns, "_x.signal", "_x.hit")


def _counts(rows: DataFrame, by: list[str], signals: Signals, extra: list[Column]) -> DataFrame:
    """Rows of each group and hits of each signal, long: by, extra names, signal, k."""
    counted = rows.groupBy(*by).agg(*extra, *(F.count_if(F.coalesce(f(), F.lit(False))).alias(n) for n, f in signals.items()))
    return counted


def against_controls(rows: DataFrame, signals: Signals) -> DataFrame:
    """grp, signal, k1 and n1 of the group's targets, k2 and n2 of all controls."""
    counted = _counts(rows, ["is_control", "grp"], signals, [F.count(F.lit(1)).alias("n")])
    per = F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("k")) for n in signals)))
    long = counted.withColumn("_x", per).select("is_control", "grp", "n", "_x.signal", "_x.k")
    targets = long.where(~F.col("is_control")).select("grp", "signal", F.col("k").alias("k1"), F.col("n").alias("n1"))
    controls = long.where("is_control").groupBy("signal").agg(F.sum("k").alias("k2"), F.sum("n").alias("n2"))
    return targets.join(controls, "signal").select("grp", "signal", "k1", "n1", "k2", "n2")


def both_sides(long: DataFrame, by: list[str]) -> DataFrame:
    """Hits and rows of targets (k1, n1) and controls (k2, n2) of each group of long signal rows."""
    target, hit = ~F.col("is_control"), F.col("hit")
    return long.groupBy(*by).agg(F.count_if(target & hit).alias("k1"), F.count_if(target).alias("n1"), F.count_if(~target & hit).alias("k2"), F.count_if(~target).alias("n2"))


def stratum_tables(rows: DataFrame, signals: Signals, least: int = 2) -> DataFrame:
    """2x2 tables (a, b of targets; c, d of controls) of each group, signal and stratum with least rows on both sides.

    Targets and controls are counted apart and joined on the stratum: controls are
    not repeated for each group before they are counted.
    """
    counted = _counts(rows, ["stratum", "is_control", "grp"], signals, [F.count(F.lit(1)).alias("n")])
    names = list(signals)
    targets = counted.where(~F.col("is_control")).select("stratum", "grp", F.col("n").alias("n1"), *(F.col(x).alias(f"t_{x}") for x in names))
    controls = counted.where("is_control").groupBy("stratum").agg(F.sum("n").alias("n2"), *(F.sum(x).alias(f"c_{x}") for x in names))
    met = targets.join(controls, "stratum").where((F.col("n1") >= least) & (F.col("n2") >= least))
    per = F.explode(F.array(*(F.struct(F.lit(x).alias("signal"), F.col(f"t_{x}").alias("a"), (F.col("n1") - F.col(f"t_{x}")).alias("b"), F.col(f"c_{x}").alias("c"), (F.col("n2") - F.col(f"c_{x}")).alias("d")) for x in names)))
    return met.withColumn("_x", per).select("grp", "_x.signal", "stratum", "_x.a", "_x.b", "_x.c", "_x.d")
