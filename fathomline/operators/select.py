"""Predicates, order and pages over scored rows (id, score, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import signals

# Ratings that count as heritage.
RATED = ["National", "Regional", "International"]


def valid_score(score: Column) -> Column:
    """score, null if it is not finite, so that it sorts last."""
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), None).otherwise(score)


def matching(rows: DataFrame, ident=None, group=None, is_control=None, min_score=None) -> DataFrame:
    """Rows that meet every condition given; comparisons reach the scan."""
    for name, value in (("id", ident), ("grp", group), ("is_control", is_control)):
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows if min_score is None else rows.where(F.col("score") >= min_score)


def order() -> list[Column]:
    """Highest score first, without a score last, then by id."""
    return [F.desc_nulls_last("score"), F.col("id").asc()]


def bounded(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Sorted rows from offset on, limit of them (0: all)."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    out = rows.orderBy(*order())
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def after(rows: DataFrame, score: float | None, ident) -> DataFrame:
    """Rows that come after a cursor; a null score is one among the rows without."""
    later = F.col("score").isNull() & (F.col("id") > F.lit(ident))
    if score is not None:
        later = F.col("score").isNull() | (F.col("score") < score) | ((F.col("score") == score) & (F.col("id") > F.lit(ident)))
    return rows.where(later)


def page(rows: DataFrame, size: int) -> DataFrame:
    """The first size rows in order, each with has_more: whether there are others. Reads one row more than it returns."""
    some = bounded(rows, size + 1)
    return some.withColumn("_rn", F.row_number().over(Window.orderBy(*order()))).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size).where(F.col("_rn") <= size).drop("_rn")


def report_sorted(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Rows by key in either direction; ids of one key always ascend."""
    return rows.orderBy(F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), F.col("id").asc())


def options(fields: DataFrame) -> DataFrame:
    """Distinct values of each column, as (field, value)."""
    long = fields.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, fields.columns)), F.array(*(F.col(c).cast("string") for c in fields.columns)))).alias("field", "value"))
    return long.where("value IS NOT NULL").distinct().orderBy("field", "value")


def catalogue(rows: DataFrame, flags: str, names: list[str]) -> DataFrame:
    """Count and percentage of rows with each named flag, 0 included, in one pass over the rows."""
    n = rows.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(F.when(F.array_contains(flags, x), 1)).alias(x) for x in names))
    items = F.explode(F.array(*(F.struct(F.lit(x).alias("flag"), F.col(x).alias("n"), (F.col(x) * 100.0 / F.col("_rows")).alias("percent")) for x in names)))
    return n.select(items.alias("x")).select("x.*")


def walk(rows: DataFrame, flags: str, themes: list[str]) -> DataFrame:
    """For each theme in turn its best row that no earlier theme has taken.

    At most as many rows as there are themes come before in a theme's order, so
    those best ones of every theme are enough to choose from.
    """
    best = None
    for i, theme in enumerate(themes):
        some = bounded(rows.where(F.array_contains(flags, theme)), len(themes)).select("id", "score").withColumn("theme", F.lit(theme)).withColumn("_i", F.lit(i))
        best = some if best is None else best.unionByName(some)
    per = F.collect_list(F.struct("_i", F.expr("-score").alias("_s"), "id", "score", "theme"))
    sorted_ = best.agg(F.sort_array(per).alias("all"))
    empty = F.array().cast("array<struct<_i:int,_s:double,id:bigint,score:double,theme:string>>")
    pick = F.aggregate(
        "all", empty, lambda got, x: F.when(F.exists(got, lambda y: (y["id"] == x["id"]) | (y["theme"] == x["theme"])), got).otherwise(F.concat(got, F.array(x)))
    )
    return sorted_.select(F.explode(pick).alias("x")).select("x.*").drop("_i", "_s")


def report_filter(
    q: str | None = None,
    group: str | None = None,
    century: str | None = None,
    rating: str | None = None,
    kind: str | None = None,
    county: str | None = None,
    review: str | None = None,
    pattern: str | None = None,
    culture: str | None = None,
    min_score: float | None = None,
    angle: bool = False,
    ratio: float | None = None,
    circular: bool = False,
    multi: int | None = None,
    civic: list[str] | None = None,
) -> Column:
    """Whether a row passes all filters that are given.

    q is part of the name in any case; review none means without a review; pattern
    is one of the flags and multi their least number; ratio the most percent that the
    aspect is off the golden one; culture is a lens: named (with a name), heritage
    (rated), pobal (deprivation of 7 or more) or civic (one of the groups in civic).
    """
    tests = [F.col(name) == value for name, value in (("grp", group), ("century", century), ("rating", rating), ("kind", kind), ("county", county)) if value is not None]
    if q:
        tests.append(F.contains(F.lower("name"), F.lit(q.lower())))
    if review is not None:
        tests.append(F.col("review") == ("" if review == "none" else review))
    if pattern:
        tests.append(F.array_contains("flags", pattern))
    if multi is not None:
        tests.append(F.size("flags") >= multi)
    if circular:
        tests.append(F.array_contains("flags", "circular"))
    if min_score is not None:
        tests.append(F.col("score") >= min_score)
    if angle:
        tests.append(signals.golden_angle(F.col("angle")))
    if ratio is not None:
        tests.append(signals.golden_error(F.col("aspect")) <= ratio)
    if culture is not None:
        lenses = {"named": F.trim("name") != "", "heritage": F.col("rating").isin(RATED), "pobal": F.col("deprivation") >= 7, "civic": F.col("grp").isin(civic or [])}
        if culture not in lenses:
            raise ValueError(f"unknown lens: {culture}")
        tests.append(lenses[culture])
    return F.coalesce(reduce(Column.__and__, tests, F.lit(True)), F.lit(False))


def numbered(rows: DataFrame, name: str, width: float) -> DataFrame:
    """Rows with their place in order, from 1.

    One window over everything would put all rows into one task. Rows are numbered
    within bands of scores of the given width instead, and the bands' sizes, a row
    for each, are added up in front.
    """
    banded = rows.withColumn("_band", F.coalesce(F.floor(-F.col("score") / F.lit(float(width))), F.lit((1 << 63) - 1)))
    sizes = banded.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_band", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_band").orderBy(*order()))
    return banded.withColumn("_i", inside).join(before, "_band").withColumn(name, F.col("_before") + F.col("_i")).drop("_band", "_i", "_before")
