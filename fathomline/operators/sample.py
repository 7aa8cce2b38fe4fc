"""Deterministic samples, splits and resampling."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import stats
from fathomline.sources.store import Scratch


def unit(seed: str, ident: Column) -> Column:
    """A number from 0 to 1 (exclusive) that the seed and the id decide: 48 bits of their SHA-256."""
    h = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), ident.cast("string")), 256), 1, 12)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(16**12))


def holdout(rows: DataFrame, ident: str, seed: str, fraction: float) -> DataFrame:
    """Add is_holdout; the split does not depend on other rows or their order."""
    return rows.withColumn("is_holdout", unit(seed, F.col(ident)) < fraction)


def systematic(rows: DataFrame, ident: str, every: int) -> DataFrame:
    return rows.where(F.pmod(F.col(ident), F.lit(every)) == 0)


def simple(rows: DataFrame, ident: str, seed: str, n: int) -> DataFrame:
    """n rows without replacement, those with the least hash, by id; a bounded top-k in each task."""
    return rows.orderBy(unit(seed, F.col(ident)), ident).limit(n).orderBy(ident)


#: Ranges of hash among which the draws of a bootstrap are split, a power of two; weights that a task draws at once.
RANGES, AT_ONCE = 256, 1 << 22


def split_draws(draws: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of each iteration's draws fall into each range, by halving: a half gets a binomial share of its node's draws, by its share of the blocks.

    draws: a number for each iteration. counts: blocks of each range, a power of two of
    them. The result has a row for each iteration, and its rows add up to draws.
    """
    levels = [counts]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    here = draws[:, None]
    for below in reversed(levels[:-1]):
        pairs = below.reshape(-1, 2)
        whole = pairs.sum(axis=1)
        left = rng.binomial(here, np.where(whole > 0, pairs[:, 0] / np.maximum(whole, 1), 0.0))
        here = np.stack([left, here - left], axis=2).reshape(len(draws), -1)
    return here


def bootstrap_sums(cells: DataFrame, by: list[str], iterations: int, seed: int) -> DataFrame:
    """by, iteration and the sums of k1, n1, k2, n2 over as many blocks, drawn with replacement, as the group has.

    A group's number of draws is split among ranges of its blocks' hash, where each
    range's own are drawn: exactly what drawing from all blocks gives, though no task
    sees more than a range.
    """
    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in by)
    sums = ["k1", "n1", "k2", "n2"]
    rows = cells.select(*by, "cell", *sums, F.pmod(F.xxhash64(F.lit(seed), "cell"), F.lit(RANGES)).cast("int").alias("_range"))
    counts = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.groupBy(*by).agg(F.collect_list(F.struct("_range", "_n")).alias("_ranges"))  # RANGES entries at most
    whole = whole.withColumn("_key", F.xxhash64(F.lit(seed), *by))

    def split(batches):
        for part in batches:
            out = []
            for _, row in part.iterrows():
                n = np.zeros(RANGES, np.int64)
                for r in row["_ranges"]:
                    n[r["_range"]] = r["_n"]
                rng = np.random.Generator(np.random.Philox(key=[seed, int(row["_key"]) & (2**64 - 1)]))
                drawn = split_draws(np.full(iterations, n.sum()), n, rng)
                out += [(*(row[c] for c in by), i, drawn[:, i].tolist(), int(row["_key"])) for i in np.flatnonzero(n).tolist()]
            yield pd.DataFrame(out, columns=[*by, "_range", "_draws", "_key"])

    shares = whole.mapInPandas(split, f"{kinds}, _range int, _draws array<bigint>, _key long")

    def draw(key: tuple, own: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        own, row = own.sort_values(["cell", *sums]), share.iloc[0]
        rng = np.random.Generator(np.random.Philox(key=[(int(row["_key"]) + 1) & (2**64 - 1), int(row["_range"])]))
        values, n = own[sums].to_numpy(np.int64), len(own)
        made = np.zeros((iterations, len(sums)), np.int64)
        step = max(1, AT_ONCE // n)
        for low in range(0, iterations, step):
            part = row["_draws"][low : low + step]
            weight = np.stack([np.bincount(rng.integers(0, n, int(m)), minlength=n) for m in part])
            made[low : low + step] = weight @ values
        frame = pd.DataFrame(made, columns=sums)
        frame.insert(0, "iteration", np.arange(iterations))
        for at, (name, value) in enumerate(zip(by, key)):
            frame.insert(at, name, value)
        return frame

    grouped = rows.groupBy(*by, "_range").cogroup(shares.groupBy(*by, "_range"))
    made = grouped.applyInPandas(draw, f"{kinds}, iteration int, " + ", ".join(f"{c} long" for c in sums))
    return made.groupBy(*by, "iteration").agg(*(F.sum(c).alias(c) for c in sums))


def block_bootstrap(cells: DataFrame, by: list[str], iterations: int = 200, seed: int = 1) -> DataFrame:
    """Bootstrap of the difference of rates over blocks: cells has by, cell (long), k1, n1, k2, n2 (one row for each cell).

    Blocks with both sides count. As many as there are are drawn with replacement in
    each iteration. Bounds are the values at floor(q * (n - 1)) of the sorted
    differences. A group without such blocks is insufficient_overlap, with nulls.
    """
    sums = ["k1", "n1", "k2", "n2"]
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    seen = cells.groupBy(*by).agg(F.count_if(both).alias("blocks"), *(F.coalesce(F.sum(F.when(both, F.col(c))), F.lit(0)).alias(c) for c in sums))
    diff = bootstrap_sums(cells.where(both), by, iterations, seed).withColumn("d", F.col("k1") / F.col("n1") - F.col("k2") / F.col("n2"))
    out = diff.groupBy(*by).agg(F.sort_array(F.collect_list("d")).alias("all"), F.avg((F.col("d") > 0).cast("int")).alias("p_positive"), F.avg((F.col("d") < 0).cast("int")).alias("p_negative"))  # iterations of a group
    at = lambda q: F.get("all", F.floor((F.size("all") - 1) * F.lit(q)).cast("int"))
    out = out.select(*by, F.size("all").alias("iterations"), at(0.025).alias("low"), at(0.5).alias("median"), at(0.975).alias("high"), "p_positive", "p_negative")
    met = seen.join(out, by, "left")
    observed = F.when(F.col("blocks") > 0, F.col("k1") / F.nullif("n1", F.lit(0)) - F.col("k2") / F.nullif("n2", F.lit(0)))
    status = F.when(F.col("blocks") > 0, "available").otherwise("insufficient_overlap")
    return met.select(*by, "blocks", "n1", "n2", observed.alias("observed"), F.coalesce("iterations", F.lit(0)).alias("iterations"), "low", "median", "high", "p_positive", "p_negative", status.alias("status"))


def permutation(rows: DataFrame, stratum: str, ident: str, label: str, hit: str, iterations: int = 200, seed: int = 1) -> DataFrame:
    """Permutation of labels within strata: observed difference of hits, and (1 + draws at least as large) / (1 + draws).

    Shuffling labels within a stratum draws the hits among its labelled rows from a
    hypergeometric distribution, so the counts of each stratum are all that is
    needed: one small row for each stratum, whatever its size.
    """
    cells = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("m"), F.count_if(hit).alias("k"), F.count_if(F.col(label) & F.col(hit)).alias("o"))
    cells = cells.withColumn("h", F.xxhash64(F.lit(seed), stratum))

    def draw(batches):
        for part in batches:
            total = np.zeros(iterations, np.int64)
            for n, m, k, h in zip(part["n"], part["m"], part["k"], part["h"]):
                total += np.random.Generator(np.random.Philox(key=[seed, h & (2**64 - 1)])).hypergeometric(k, n - k, m, iterations) if 0 < k and 0 < m else 0
            yield pd.DataFrame({"iteration": np.arange(iterations), "hits": total})

    drawn = cells.mapInPandas(draw, "iteration int, hits long").groupBy("iteration").agg(F.sum("hits").alias("hits"))
    observed = cells.agg(F.sum("o").alias("observed"), F.sum("m").alias("labelled"), F.count(F.lit(1)).alias("strata"))
    met = drawn.crossJoin(observed)  # one row
    return met.groupBy("observed", "labelled", "strata").agg(F.avg("hits").alias("expected"), ((1 + F.count_if(F.col("hits") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"))


def orientation_null(observed: DataFrame, iterations: int = 200, seed: int = 1) -> DataFrame:
    """Chance of at least the observed counts (n, wide, core, peak) among n directions drawn evenly from 180 degrees.

    wide is within 3 degrees of one direction, core within 1, peak the most that any of
    180 whole directions has within 10. How many directions fall into which degree is
    a multinomial draw, so the work of an iteration does not grow with n. Result: a row
    for each of the three with observed, expected and p, (1 + draws at least as large) /
    (1 + draws).
    """

    def draw(batches):
        for part in batches:
            for n in part["n"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, int(n)]))
                cells = np.concatenate([np.zeros((iterations, 1), np.int64), rng.multinomial(n, np.full(180, 1 / 180), iterations).cumsum(axis=1)], axis=1)
                g = np.arange(180)
                peak = (cells[:, np.minimum(180, g + 10)] - cells[:, np.maximum(0, g - 10)]).max(axis=1)
                wide = rng.binomial(n, 6 / 180, iterations)
                yield pd.DataFrame({"n": n, "wide": wide, "core": rng.binomial(wide, 1 / 3), "peak": peak})

    drawn = observed.select("n").mapInPandas(draw, "n long, wide long, core long, peak long")
    long = lambda df, value: df.unpivot(["n"], ["wide", "core", "peak"], "band", value)
    met = long(drawn, "draw").join(long(observed.select("n", *(F.col(c).cast("long") for c in ("wide", "core", "peak"))), "observed"), ["n", "band"])
    return met.groupBy("n", "band", "observed").agg(F.avg("draw").alias("expected"), ((1 + F.count_if(F.col("draw") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"))


def moran_permutation(values: DataFrame, edges: DataFrame, iterations: int = 100, seed: int = 1) -> DataFrame:
    """Moran's I of flags (id, v of 0 and 1) over edges (id, id2), and how often as many flags in other places reach it: n, edges, moran_i, expected, p.

    In an iteration the flags go to the rows with the least hashes, as many as there
    are. The hash that this ends at is a quantile, found for all iterations together;
    they are one number each, and what a row has in them is an array.
    """
    n, ones = values.agg(F.count(F.lit(1)), F.sum("v")).first()
    turns = F.sequence(F.lit(0), F.lit(iterations - 1))
    unit = lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), i, F.col("id")), 11) / F.lit(float(1 << 53)))
    hashed = values.select("id", F.explode(turns).alias("turn")).withColumn("u", unit(F.col("turn")))
    cuts = stats.quantiles(hashed, ["turn"], "u", 1 / 256, {"cut": ones / n}).collect()  # iterations
    limits = F.array(*(F.lit(r["cut"]) for r in sorted(cuts, key=lambda r: r["turn"])))
    mean = ones / n
    own = F.concat(F.array(F.col("v") - F.lit(mean)), F.transform(turns, lambda i: F.when(unit(i) < F.get(limits, i), 1.0).otherwise(0.0) - F.lit(mean)))
    z = values.select("id", own.alias("z"))
    met = edges.select("id", "id2").join(z, "id").join(z.select(F.col("id").alias("id2"), F.col("z").alias("z2")), "id2")
    sums = met.select(F.posexplode(F.zip_with("z", "z2", lambda a, b: a * b)).alias("turn", "x")).groupBy("turn").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("edges"))
    i = sums.select("turn", "edges", (F.col("x") * F.lit(n) / F.col("edges") / F.lit(ones * (1 - mean))).alias("i"))
    seen = i.where("turn = 0").select("edges", F.col("i").alias("moran_i"))
    out = i.where("turn > 0").select("i").crossJoin(seen)  # one row
    return out.groupBy("edges", "moran_i").agg(F.avg("i").alias("expected"), ((1 + F.count_if(F.col("i") >= F.col("moran_i") - 1e-12)) / (1 + F.count(F.lit(1)))).alias("p")).withColumn("n", F.lit(n))


def clouds(frame: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Random points id, x, y for each iteration: as many as frame (one row: x0, x1, y0, y1, n) says, even over its box, and the iteration.

    Clouds lie side by side, ten widths apart, so that all of them are one table of
    points in which nobody's nearest is in another cloud.
    """
    unit = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "iteration", "i"), 11) / F.lit(float(1 << 53))
    rows = frame.select("x0", "x1", "y0", "y1", "n", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    rows = rows.repartition("iteration").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).where("n > 0")
    gap = 10 * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    x = F.col("x0") + unit("x") * (F.col("x1") - F.col("x0")) + F.col("iteration") * gap
    return rows.select("iteration", (F.col("iteration") * F.col("n") + F.col("i")).alias("id"), x.alias("x"), (F.col("y0") + unit("y") * (F.col("y1") - F.col("y0"))).alias("y"))


#: Points of a cell, on average, in which the nearest of evenly spread points are looked for first.
EVEN = 4


def _even_nearest(made: DataFrame, width: float, height: float, n: int, scratch: Scratch) -> DataFrame:
    """iteration, id and d, the distance to the nearest other point, of clouds of n points spread evenly over boxes of this size.

    Cells of EVEN points hold nearly everyone's nearest, as far as a cell is wide; who
    has none there looks four times as far, and so on to the end of the cloud.
    """
    from fathomline.operators.spatial import within

    radius = max(math.sqrt(EVEN * width * height / n), EVEN * max(width, height) / n)
    other, left, done = made.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2")), made, []
    for turn in itertools.count():
        pairs = within(left, other, radius) if not turn else within(other, left, radius, lx="x2", ly="y2", rx="x", ry="y")
        found = scratch.save(pairs.where("id <> id2").groupBy("iteration", "id").agg(F.sqrt(F.min("d2")).alias("d")), f"even{turn}")
        done.append(found)
        left = scratch.save(left.join(found, ["iteration", "id"], "left_anti"), f"alone{turn}")
        if radius > width + height or left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        radius *= 4


def cloud_null(points: DataFrame, near: Column, scratch: Scratch, iterations: int = 150, seed: int = 1) -> DataFrame:
    """How often clouds of as many random points in the same box have as large a share of nearest distances d with ``near``: one row of n, observed, expected and p, (1 + clouds at least as large) / (1 + clouds).

    The distances of all clouds are found by one join of cells, so the work is in proportion to
    iterations x points. Fewer than two points have no distances: all but n are null.
    """
    from fathomline.operators.neighbours import k_nearest

    known = points.where("x IS NOT NULL AND y IS NOT NULL")
    frame = known.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
    made = scratch.save(clouds(frame, iterations, seed), "clouds")
    share = F.avg(near.cast("double"))
    found = lambda rows, name: k_nearest(rows, rows, 1, Scratch(scratch.spark, name), others=True).withColumn("d", F.sqrt("d2"))
    seen = found(known, "seen").agg(F.count(F.lit(1)).alias("n"), share.alias("observed"))
    x0, x1, y0, y1, n = frame.first()
    even = Scratch(scratch.spark, "even")
    if n and max(x1 - x0, y1 - y0) > 0:
        near_of = _even_nearest(made, x1 - x0, y1 - y0, n, even)
    else:  # all at one place
        near_of = found(made.select("id", "x", "y"), "drawn").withColumn("iteration", F.floor(F.col("id") / F.lit(max(n, 1))))
    drawn = scratch.save(near_of.groupBy("iteration").agg(share.alias("share")), "shares")
    even.clear()
    scratch.drop("clouds")
    met = seen.join(drawn, F.lit(True), "left")  # one row
    as_large = F.count_if(F.col("share") >= F.col("observed"))
    return met.groupBy("n", "observed").agg(F.avg("share").alias("expected"), F.when(F.count("share") > 0, (1 + as_large) / (1 + F.count("share"))).alias("p"))
