"""Joins and statistics of points in the plane.

Points near each other are found by equality of grid cells, one side repeated in
the neighbouring cells, so that Spark joins by hash or sort on the cell and the
exact distance only filters. Cells are as wide as the search radius.
"""

from __future__ import annotations

import itertools
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.neighbours import k_nearest
from fathomline.operators.skew import salted
from fathomline.sources.store import Scratch


def _around(df: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    """Each row in its own cell and the eight around it."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    out = df.withColumn("_s", F.explode(steps))
    return out.withColumn("_cx", F.floor(F.col(x) / radius) + F.col("_s.i")).withColumn("_cy", F.floor(F.col(y) / radius) + F.col("_s.j")).drop("_s")


def _own(df: DataFrame, x: str, y: str, radius: float) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / radius)).withColumn("_cy", F.floor(F.col(y) / radius))


def within(left: DataFrame, right: DataFrame, radius: float, keys: list[str] | None = None, lx="x", ly="y", rx="x2", ry="y2") -> DataFrame:
    """Pairs of rows at most radius apart, with d2, the squared distance; keys: further columns that must be equal."""
    met = _own(left, lx, ly, radius).join(_around(right, rx, ry, radius), [*(keys or []), "_cx", "_cy"])
    d2 = F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2)
    return met.drop("_cx", "_cy").withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def nearest(pairs: DataFrame, by: str | list[str], order: list, k: int = 1, name: str = "rank") -> DataFrame:
    """The k best pairs of each row; Spark drops the rest of a partition before it shuffles."""
    by = [by] if isinstance(by, str) else by
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return pairs.withColumn(name, rank).where(F.col(name) <= k)


def nearest_within(points: DataFrame, radius: float, k: int, scratch: Scratch) -> DataFrame:
    """The k nearest other points of each point (id, x, y) at most radius away: id, x, y, id2, x2, y2, d2, rank; ties by id2.

    Rows meet the places near them, not all within the radius, so the work does not grow with density.
    """
    rows = points.select(F.struct("id", "x", "y").alias("id"), "x", "y")
    found = k_nearest(rows, rows, k, scratch, others=True, within=radius)
    return found.select("id.*", F.col("id2.id").alias("id2"), F.col("id2.x").alias("x2"), F.col("id2.y").alias("y2"), "d2", "rank")


def contain_else_near(boxes: DataFrame, points: DataFrame, radius: float, cell: float) -> DataFrame:
    """For each box (id, x0, y0, x1, y1) the point (pid, x, y) nearest to its centre: of those inside, else of those within radius.

    A point inside that no other is nearer than is the one, so that boxes in dense places meet
    the places near their centres only. The other boxes are put into every cell that they, grown
    by the radius, touch; a box of many cells is spread over them. mode is 0 for contained and 1 for near.
    """
    scratch = Scratch(boxes.sparkSession, "contain")
    grown = boxes.withColumn("_x", (F.col("x0") + F.col("x1")) / 2).withColumn("_y", (F.col("y0") + F.col("y1")) / 2)
    d2 = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    named = grown.select(F.struct("id", "x0", "y0", "x1", "y1", "_x", "_y").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    other = points.select(F.struct("pid", "x", "y").alias("id"), "x", "y")
    found = k_nearest(named, other, 1, scratch).select("id.*", F.col("id2.pid").alias("pid"), F.col("id2.x").alias("x"), F.col("id2.y").alias("y"))
    first = scratch.save(found.where(inside).select("id", "pid", F.lit(0).alias("mode"), d2.alias("d2")), "first")
    open_ = scratch.save(grown.join(first.select("id"), "id", "left_anti"), "open")
    reach_x0, reach_x1 = F.least(F.col("x0"), F.col("_x") - radius), F.greatest(F.col("x1"), F.col("_x") + radius)
    reach_y0, reach_y1 = F.least(F.col("y0"), F.col("_y") - radius), F.greatest(F.col("y1"), F.col("_y") + radius)
    spread = open_.withColumn("_cx", F.explode(F.sequence(F.floor(reach_x0 / cell), F.floor(reach_x1 / cell))))
    spread = spread.withColumn("_cy", F.explode(F.sequence(F.floor(reach_y0 / cell), F.floor(reach_y1 / cell))))
    met = salted(_own(points, "x", "y", cell), spread, ["_cx", "_cy"], F.struct("x", "y", "pid"))
    met = met.withColumn("mode", F.when(inside, 0).when(d2 <= radius * radius, 1)).withColumn("d2", d2).where("mode IS NOT NULL")
    return first.unionByName(nearest(met, "id", ["mode", "d2", "pid"]).select("id", "pid", "mode", "d2"))


def first_feature(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Each point with the first box (by seq) that holds it; null if none does."""
    spread = boxes.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))))
    spread = spread.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    met = salted(_own(points, "x", "y", cell), spread, ["_cx", "_cy"], F.col("id"))
    met = met.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    found = met.groupBy("id").agg(F.min("seq").alias("seq"))
    return points.join(found, "id", "left")


def match(targets: DataFrame, controls: DataFrame, max_distance: float, k: int, per_bin: int = 24, bins: int = 2, hard: list[str] | None = None) -> DataFrame:
    """Match targets to controls (id, x, y, area, bin): cost distance / max_distance + gap of the areas' log10.

    Of each of the size bins up to ``bins`` apart the per_bin nearest controls come
    into question; the k of least cost, ties by id, are kept with their rank.
    """
    by = ("bin", *(hard or []))
    own = F.struct(*(c for c in targets.columns if c not in by))
    spread = targets.select(own.alias("id"), "x", "y", *by[1:], F.explode(F.sequence(F.col("bin") - bins, F.col("bin") + bins)).alias("bin"))
    other = controls.select(F.struct(F.col("id").alias("cid"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("area").alias("area2")).alias("id"), "x", "y", *by)
    pairs = k_nearest(spread, other, per_bin, Scratch(targets.sparkSession, "match"), by=by, within=max_distance).select("id.*", *by, "id2.*", "d2")
    cost = F.sqrt("d2") / max_distance + F.abs(F.log10("area") - F.log10("area2"))
    return nearest(pairs.withColumn("cost", cost), "id", ["cost", "cid"], k)


#: Candidates of a stratum that one task chooses among; larger strata choose in rounds.
STRATUM_ROWS = 100_000


def assign_once(candidates: DataFrame, scratch: Scratch, k: int = 1, stratum: str = "stratum", bound: int = STRATUM_ROWS) -> DataFrame:
    """Each control at most once: within a stratum targets with the fewest candidates choose first, then those of least priority (a column, if there is one), then by id; each takes its k cheapest free ones (cost, then cid).

    A stratum of up to ``bound`` candidates is one group. In a larger one targets do
    not choose one after another: in each round every target asks for the k cheapest
    controls that have not refused it, and every control keeps the first of those who
    ask, in the order of choice, and refuses the others. When none is refused the
    result is that of the sequence. A round writes its refusals.
    """
    first = F.min("priority").cast("double") if "priority" in candidates.columns else F.lit(0.0)
    counts = candidates.groupBy(stratum, "id").agg(F.count(F.lit(1)).alias("_n"), first.alias("_p"))
    sizes = counts.groupBy(stratum).agg(F.sum("_n").alias("_size"))
    pairs = scratch.save(candidates.select(stratum, "id", "cid", "cost").join(counts, [stratum, "id"]).join(sizes, stratum), "candidates")
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    schema = f"{stratum} {kinds[stratum]}, id {kinds['id']}, cid {kinds['cid']}, cost double, rank int"

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        used, kept = set(), []
        for _, own in rows.sort_values(["_n", "_p", "id", "cost", "cid"], kind="stable").groupby(["_n", "_p", "id"], sort=True):
            free = own[~own["cid"].isin(used)].head(k)
            used.update(free["cid"])
            kept.append(free.assign(rank=range(1, len(free) + 1)))
        return pd.concat(kept)[[stratum, "id", "cid", "cost", "rank"]]

    small = pairs.where(F.col("_size") <= bound).groupBy(stratum).applyInPandas(choose, schema)
    pairs = pairs.where(F.col("_size") > bound)
    if pairs.isEmpty():
        return small
    refused = []
    for turn in itertools.count():
        left = pairs
        if refused:
            left = left.join(reduce(DataFrame.unionByName, refused), [stratum, "id", "cid"], "left_anti")
        asked = nearest(left, [stratum, "id"], ["cost", "cid"], k)
        asked = scratch.save(asked.withColumn("_first", F.min(F.struct("_n", "_p", "id")).over(Window.partitionBy(stratum, "cid"))), f"asked{turn}")
        lost, n = scratch.save_counted(asked.where(F.col("_first.id") != F.col("id")).select(stratum, "id", "cid"), f"refused{turn}")
        if not n:
            return small.unionByName(asked.select(stratum, "id", "cid", "cost", "rank"))
        refused.append(lost)


#: What a pair of known but different eras costs more.
ERA_PENALTY = 0.25


def strict_match(pairs: DataFrame, covariates: DataFrame, scratch: Scratch, k: int = 1) -> DataFrame:
    """Matches without reuse within hard strata, from candidate pairs (id, cid, cost): stratum, id, cid, cost, rank, era_comparable, era_gap.

    covariates: id (targets and controls, each once), stratum, era (null or empty: not
    known) and score. Pairs of different strata, or of ids without a row, do not count; a
    null stratum is one. Two known eras that differ cost ERA_PENALTY more. Targets with
    the fewest candidates choose first, then those of the highest score, then by id.
    """
    known = F.nullif(F.trim("era"), F.lit(""))
    own = covariates.select("id", F.coalesce("stratum", F.lit("unknown")).alias("stratum"), known.alias("era"), (-F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("priority"))
    other = own.select(F.col("id").alias("cid"), F.col("stratum").alias("stratum2"), F.col("era").alias("era2"))
    met = pairs.select("id", "cid", "cost").join(own, "id").join(other, "cid").where(F.col("stratum") == F.col("stratum2"))
    comparable = F.col("era").isNotNull() & F.col("era2").isNotNull()
    met = met.withColumn("era_comparable", comparable).withColumn("era_gap", comparable & F.coalesce(F.col("era") != F.col("era2"), F.lit(False)))
    met = met.withColumn("cost", F.col("cost") + F.when(F.col("era_gap"), ERA_PENALTY).otherwise(0.0))
    met = scratch.save(met.select("stratum", "id", "cid", "cost", "priority", "era_comparable", "era_gap"), "strict")
    taken = assign_once(met, scratch, k)
    return taken.join(met.select("stratum", "id", "cid", "era_comparable", "era_gap"), ["stratum", "id", "cid"])


def strict_summary(targets: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """One row: target_n, fully, partially and unmatched targets (id), pair_n and unique_controls."""
    per = matches.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    met = targets.select("id").distinct().join(per, "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    one = met.agg(F.count(F.lit(1)).alias("target_n"), F.count_if(F.col("n") >= k).alias("fully_matched"), F.count_if(F.col("n").between(1, k - 1)).alias("partially_matched"), F.count_if(F.col("n") == 0).alias("unmatched"))
    return one.crossJoin(matches.agg(F.count(F.lit(1)).alias("pair_n"), F.countDistinct("cid").alias("unique_controls")))  # one row each


def ripley(points: DataFrame, radii: list[float], width: float, height: float) -> DataFrame:
    """Ripley's K and L - r of points (id, x, y) in a box, with translation correction of the edges."""
    other = points.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = within(points, other, max(radii)).where("id <> id2")
    overlap = (width - F.abs(F.col("x") - F.col("x2"))) * (height - F.abs(F.col("y") - F.col("y2")))
    weight = F.lit(width * height) / overlap
    sums = pairs.agg(*(F.coalesce(F.sum(F.when(F.col("d2") <= r * r, weight)), F.lit(0.0)).alias(f"s{i}") for i, r in enumerate(radii)))
    met = sums.crossJoin(points.agg(F.count(F.lit(1)).alias("n")))  # one row each
    rows = F.explode(F.array(*(F.struct(F.lit(float(r)).alias("r"), F.col(f"s{i}").alias("s")) for i, r in enumerate(radii))))
    k = F.col("x.s") * F.lit(width * height) / (F.col("n") * (F.col("n") - 1))
    return met.select("n", rows.alias("x")).select(F.col("x.r").alias("r"), k.alias("k"), (F.sqrt(k / F.lit(3.141592653589793)) - F.col("x.r")).alias("l_minus_r"))


def moran(values: DataFrame, edges: DataFrame, value: str = "v") -> DataFrame:
    """Moran's I of values (id, v) over directed edges (id, id2) of weight 1."""
    mean = values.agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("n"))
    dev = values.crossJoin(mean).select("id", (F.col(value) - F.col("_m")).alias("z"), "n")  # the mean is one row
    met = edges.join(dev.select("id", "z"), "id").join(dev.select(F.col("id").alias("id2"), F.col("z").alias("z2")), "id2")
    top = met.agg(F.sum(F.col("z") * F.col("z2")).alias("top"), F.count(F.lit(1)).alias("w"))
    bottom = dev.agg(F.sum(F.col("z") * F.col("z")).alias("bottom"), F.first("n").alias("n"))
    return top.crossJoin(bottom).select("n", F.col("w").alias("edges"), (F.col("n") / F.col("w") * F.col("top") / F.col("bottom")).alias("moran_i"))


def unordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs."""
    return edges.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def box_join_count(points: DataFrame, boxes: DataFrame, cell: float, aggregates: list[Column]) -> DataFrame:
    """Aggregates of the points inside each box, by box id."""
    spread = boxes.select("id", "x0", "y0", "x1", "y1", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))).alias("_cx"))
    spread = spread.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    met = salted(_own(points.drop("id"), "x", "y", cell), spread, ["_cx", "_cy"], F.struct("x", "y"))
    return met.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).groupBy("id").agg(*aggregates)
