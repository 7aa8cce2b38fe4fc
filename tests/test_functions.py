"""Functions against closed forms and plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.functions import evidence, geo, limits, polygons, schedule, signals, stats
from fathomline.operators import graph, quality, sample, spatial
from fathomline.sources.store import Scratch

SQUARE = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)


def values(spark, text, column):
    return [r[0] for r in spark.createDataFrame([(t,) for t in text], "t string").select(column(F.col("t"))).collect()]


def regular(n, r=10.0):
    t = np.arange(n) * 2 * np.pi / n
    return np.column_stack([r * np.cos(t), r * np.sin(t)])


def test_square():
    d = polygons.describe(SQUARE)
    assert d["valid"] and d["area"] == 100 and d["perimeter"] == 40 and d["aspect"] == pytest.approx(1)
    assert d["circularity"] == pytest.approx(math.pi / 4) and d["convexity"] == pytest.approx(1) and d["right_fraction"] == 1
    assert d["rot180"] == pytest.approx(1) and d["rot90"] == pytest.approx(1) and d["reflect"] == pytest.approx(1)
    octagon = 2 * (math.sqrt(2) - 1)
    assert d["rot45"] == pytest.approx(octagon / (2 - octagon)) and d["vertex_density"] == pytest.approx(0.4)


def test_pentagon_and_hexagon():
    d = polygons.describe(regular(5))
    assert np.allclose(d["angles"], 108) and d["rot72"] == pytest.approx(1) and d["rot90"] < 0.95
    assert polygons.describe(regular(6))["rot60"] == pytest.approx(1)


def test_l_shape_and_bow_tie():
    d = polygons.describe(np.array([[0, 0], [2, 0], [2, 1], [1, 1], [1, 2], [0, 2]], float))
    assert d["area"] == 3 and d["convexity"] == pytest.approx(3 / 3.5)
    assert not polygons.describe(np.array([[0, 0], [2, 2], [2, 0], [0, 3]], float))["valid"]
    assert not polygons.describe(np.array([[0, 0], [1, 1]], float))["valid"]
    assert polygons.describe([[0, 0], [2, 2], [2, 0], [0, 3]])["status"] == "repaired" and polygons.describe([[0, 0], [1, 1]])["status"] == "empty"
    assert polygons.describe([[0, 0], [1, 1], [2, 2]])["status"] == "degenerate" and polygons.describe_rings(None, None)["status"] == "missing"


def test_holes_and_parts():
    outer, hole, other = [[0, 0], [2, 0], [2, 2], [0, 2]], [[0.5, 0.5], [0.7, 0.5], [0.7, 0.7], [0.5, 0.7]], [[1, 1], [3, 1], [3, 3], [1, 3]]
    p = np.array(outer + hole + other, float)
    d = polygons.describe_rings(p[:, 0], p[:, 1], [0, 4, 8], [True, False, True])
    assert (d["status"], d["parts"], d["holes"]) == ("valid", 2, 1) and d["area"] == pytest.approx(7 - 0.04) and d["hole_fraction"] == pytest.approx(0.04 / 8)
    d = polygons.describe_rings(p[:, 0], p[:, 1], [0, 4, 8], [True, True, False])  # what lies outside is no hole
    assert (d["status"], d["parts"], d["holes"]) == ("repaired", 2, 0) and d["area"] == pytest.approx(4)
    d = polygons.describe_rings(p[:8, 0], p[:8, 1], [0, 2, 4], [True, False, True])  # an outer ring without area goes with its holes
    assert (d["status"], d["parts"], d["area"]) == ("repaired", 1, pytest.approx(0.04))
    ring = np.array(outer[:1] + outer[1:], float) - 1
    frame = np.vstack([ring, ring / 2])
    d = polygons.describe_rings(frame[:, 0], frame[:, 1], [0, 4], [True, False])
    assert d["area"] == pytest.approx(3) and d["rot90"] == pytest.approx(1) and d["hole_fraction"] == pytest.approx(0.25)
    rng = np.random.default_rng(2)
    for _ in range(5):  # against points drawn at random
        t = np.sort(rng.uniform(0, 2 * np.pi, 9))
        p = np.column_stack([np.cos(t), np.sin(t)]) * rng.uniform(0.3, 1, 9)[:, None]
        c = polygons.centroid(p)
        q = (p - c) @ polygons.rotation(72).T + c
        points = rng.uniform(-1.5, 1.5, (20_000, 2))
        a, b = (np.array([polygons.contains(r, *x) for x in points]) for r in (p, q))
        assert polygons.overlaps(polygons.Shape([p], []), c, polygons.rotation(72)[None])[0] == pytest.approx((a & b).sum() / (a | b).sum(), abs=0.04)


def test_waves_of_the_outline():
    d = polygons.describe(regular(64))
    assert d["radial_cv"] < 0.01 and all(d[f"fourier_{i}"] < 0.01 for i in (1, 2, 3, 4))
    t = np.arange(720) * 2 * np.pi / 720
    r = 10 + np.cos(3 * t)
    d = polygons.describe(np.column_stack([r * np.cos(t), r * np.sin(t)]))
    assert d["fourier_3"] == pytest.approx(0.1, abs=0.02) and max(d[f"fourier_{i}"] for i in (1, 2, 4)) < 0.02


@settings(max_examples=25, deadline=None)
@given(st.floats(0, 180), st.floats(1, 50), st.floats(1, 50))
def test_box_under_rotation(theta, a, b):
    p = np.array([[0, 0], [a, 0], [a, b], [0, b]]) @ polygons.rotation(theta).T
    d = polygons.describe(p)
    assert d["area"] == pytest.approx(a * b, rel=1e-6) and d["length"] == pytest.approx(max(a, b), rel=1e-6)


def test_holm(spark):
    rows = spark.createDataFrame([("f", 0, 0.04), ("f", 1, 0.001), ("f", 2, 0.02)], "family string, i int, p double")
    got = {r["i"]: r["p_adjusted"] for r in stats.holm(rows, "p", ["family"]).collect()}
    assert got == {0: pytest.approx(0.04), 1: pytest.approx(0.003), 2: pytest.approx(0.04)}


def test_proportions(spark):
    k1, n1, k2, n2 = (F.lit(x) for x in (20, 100, 5, 100))
    z, odds, low = spark.range(1).select(stats.pooled_z(k1, n1, k2, n2), stats.odds_ratio(k1, n1, k2, n2), stats.wilson(k1, n1)[0]).first()
    assert z == pytest.approx(0.15 / math.sqrt(0.125 * 0.875 * 0.02)) and odds > 1 and 0 < low < 0.2
    p = spark.range(1).select(F.lit(1.959963984540054).alias("z")).select(stats.two_sided_p("z")).first()[0]
    assert p == pytest.approx(0.05)


def test_quantiles(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.choice([rng.randrange(5), rng.random() * 1000]))) for g in ("a", "b", "c") for _ in range(rng.randint(1, 200))] + [("d", None)]
    got = {r["g"]: (r["median"], r["p90"]) for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 3.0, {"median": 0.5, "p90": 0.9}).collect()}
    expected = {}
    for g in ("a", "b", "c"):
        v = sorted(x for h, x in rows if h == g)
        expected[g] = tuple(v[min(len(v) - 1, int(len(v) * q))] for q in (0.5, 0.9))
    assert got == expected


def test_choices_in_rounds_are_those_of_a_sequence(spark):
    rng = random.Random(3)
    rows = list({(s, i, c): (s, i, c, rng.randrange(6) / 2) for s in "xy" for i in range(25) for c in rng.sample(range(30), rng.randint(1, 9))}.values())
    rows = [(s, i if s == "x" else i + 100, c if s == "x" else c + 100, w) for s, i, c, w in rows]
    table = spark.createDataFrame(rows, "stratum string, id long, cid long, cost double")
    for k in (1, 3):
        used, expected = set(), set()
        counts = {}
        for s, i, c, w in rows:
            counts[s, i] = counts.get((s, i), 0) + 1
        for s, i in sorted(counts, key=lambda x: (counts[x], x[1])):
            free = sorted((w, c) for t, j, c, w in rows if (t, j) == (s, i) and c not in used)[:k]
            used |= {c for _, c in free}
            expected |= {(i, c) for _, c in free}
        for bound in (0, 1000) if k == 1 else (0, 110):
            assert {(r["id"], r["cid"]) for r in spatial.assign_once(table, Scratch(spark, "once"), k, bound=bound).collect()} == expected


def test_years(spark):
    text = ["1845", "c.1850-60", "950", "11925", "175", "20", "", None, "undated", "99999"]
    assert values(spark, text, limits.year) == [1845, 1850, 950, 1925, 175, None, None, None, None, None]


def test_limits(spark):
    pick = lambda f: lambda c: F.concat_ws(":", f(c)["status"], F.round(f(c)["value"], 4).cast("string"))
    assert values(spark, ["7.5 t", "none", "", "default", "3"], pick(limits.weight)) == ["supported:7.5", "unlimited", "not_provided", "unsupported", "supported:3.0"]
    assert values(spark, ["2.5", "250 cm", "6'7\"", "6'13\"", "2 metres"], pick(limits.height)) == ["supported:2.5", "supported:2.5", "supported:2.0066", "unsupported", "supported:2.0"]
    assert values(spark, ["50", "30 mph", "10 knots", "walk"], pick(limits.speed)) == ["supported:50.0", "supported:48.2803", "supported:18.52", "unsupported"]
    assert values(spark, ["8 ft 6 in", "8'", "2.1 m", "wide"], pick(limits.dimension)) == ["supported:2.5908", "supported:2.4384", "supported:2.1", "unsupported"]
    assert values(spark, ["0:45", "1:02:03", "1h 30m", "90 min", "0:75", "soon", None], limits.duration) == [2700, 3723, 5400, 5400, None, None, None]


def test_maneuvers(spark):
    rows = [(10.0, 350.0), (0.0, 20.0), (0.0, 90.0), (0.0, 170.0), (350.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double").select(geo.maneuver(geo.turn(F.col("a"), F.col("b"))))
    assert [r[0] for r in df.collect()] == ["slight-left", "slight-right", "turn-right", "sharp-right", "slight-right"]


def test_ratios(spark):
    df = spark.createDataFrame([(1.0,), (1.6,), (1.62,), (2.02,)], "a double")
    got = df.select(signals.nearest_ratio(F.col("a"))["ratio"].alias("r")).collect()
    assert [r[0] for r in got][:2] == [1.0, 1.6] and got[3][0] == 2.0


def test_schedule(spark):
    assert not schedule.parse("whenever")["supported"]
    assert schedule.parse("Fr-Mo 22:00-02:00")["spans"][0] == {"months": 4095, "start": 4 * 1440 + 1320, "end": 4 * 1440 + 1560}
    assert schedule.parse("Nov-Feb Mo 08:00-09:00")["spans"][0]["months"] == (1 << 10) | (1 << 11) | 1 | 2
    moments = ["2024-01-01 09:00:00", "2024-01-06 23:30:00", "2024-01-08 01:00:00", "2024-12-25 10:00:00", "2024-07-01 12:00:00"]
    rows = spark.createDataFrame([("Mo-Su 08:00-18:00; Su 22:00-03:00; Dec 25 off", m) for m in moments], "hours string, m string").withColumn("m", F.to_timestamp_ntz("m"))
    got = schedule.parse_column(rows, "hours").orderBy("m").select("m", schedule.active_at(F.col("schedule"), F.col("m"))).collect()
    assert [r[1] for r in got] == [True, False, True, True, False]


def test_attribution(spark):
    text = [
        "The house was designed by John Nash, 1810.", "Designed by the architect: Mary O'Brien of Cork.", "Plans, drawn by John Nash.", "A plan of the yard, attributed to James Gandon", "No name here.",
    ]
    got = values(spark, text, lambda c: F.concat_ws(":", evidence.attribution(c)["name"], evidence.attribution(c)["confidence"]))
    assert got == ["John Nash:high", "Mary O'Brien:high", "John Nash:medium", "James Gandon:high", ""]


def test_within_equals_all_pairs(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {(r["id"], r["id2"]) for r in spatial.within(df, df.toDF("id2", "x2", "y2"), 9.0).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 81}
    near = {r["id"]: r["node"] for r in graph.snap(df.where("id < 60"), df.where("id >= 60").toDF("node", "x", "y"), Scratch(spark, "snap")).collect()}
    for i, x, y in pts[:60]:
        assert near[i] == min(pts[60:], key=lambda p: ((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]))[0]


def test_assign_once(spark):
    rows = [("s", 1, 10, 0.1), ("s", 1, 11, 0.2), ("s", 2, 10, 0.05), ("t", 3, 20, 0.3), ("t", 4, 20, 0.1)]
    got = {(r["id"], r["cid"]) for r in spatial.assign_once(spark.createDataFrame(rows, "stratum string, id long, cid long, cost double"), Scratch(spark, "once"), 1).collect()}
    assert got == {(2, 10), (1, 11), (3, 20)}


def test_paths_against_dijkstra(spark):
    import heapq

    rng = random.Random(7)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(1, 20))) for _ in range(140)]
    scratch = Scratch(spark, "test")
    labels = graph.shortest(spark.createDataFrame(edges, "u long, v long, w double"), spark.createDataFrame([(0, 0, 0.0), (5, 5, 0.0)], "origin long, node long, start double"), scratch)
    for origin in (0, 5):
        best, heap = {}, [(0.0, origin)]
        while heap:
            d, n = heapq.heappop(heap)
            if n not in best:
                best[n] = d
                for u, v, w in edges:
                    if u == n:
                        heapq.heappush(heap, (d + w, v))
        assert {r["node"]: r["cost"] for r in labels.where(F.col("origin") == origin).collect()} == best
    traced = graph.paths(labels, labels.where("origin = 0"), Scratch(spark, "trace")).collect()
    length = {(u, v): min(w for a, b, w in edges if (a, b) == (u, v)) for u, v, _ in edges}
    cost = {r["node"]: r["cost"] for r in labels.where("origin = 0").collect()}
    assert traced and all(sum(length[e] for e in zip(r["path"], r["path"][1:])) == cost[r["node"]] for r in traced)


def test_only_turns_dominate(spark):
    e = spark.createDataFrame([(1, 1, 2, 9, 5), (2, 2, 3, 8, 1), (3, 2, 4, 7, 1)], "id long, u long, v long, way long, w long")
    rule = lambda *r: spark.createDataFrame(list(r), "from_way long, via long, to_way long")
    got = {(r["u"], r["v"]) for r in graph.transitions(e, rule((9, 2, 7)), rule()).collect()}
    assert got == {(1, 2)}
    assert {(r["u"], r["v"]) for r in graph.transitions(e, rule((9, 2, 7)), rule((9, 2, 7))).collect()} == {(1, 3)}


def test_split_is_stable(spark):
    rows = spark.range(1000).withColumnRenamed("id", "i")
    a = {r["i"] for r in sample.holdout(rows, "i", "s", 0.3).where("is_holdout").collect()}
    b = {r["i"] for r in sample.holdout(rows.where("i < 500"), "i", "s", 0.3).where("is_holdout").collect()}
    assert 230 < len(a) < 370 and b == {i for i in a if i < 500}


def test_bootstrap_draws_as_many_blocks_as_there_are(spark):
    cells = spark.createDataFrame([(g, i, i % 3, 1, 0, 2) for g, n in (("a", 700), ("b", 3)) for i in range(n)], "grp string, cell long, k1 long, n1 long, k2 long, n2 long")
    sums = sample.bootstrap_sums(cells.repartition(3), ["grp"], 60, 5).collect()
    assert {(r["grp"], r["n1"], r["n2"]) for r in sums} == {("a", 700, 1400), ("b", 3, 6)} and len(sums) == 120
    again = sample.bootstrap_sums(cells.repartition(7), ["grp"], 60, 5).collect()
    assert sorted(map(tuple, sums)) == sorted(map(tuple, again))
    one = [r["k1"] for r in sums if r["grp"] == "a"]
    assert abs(np.mean(one) - 699) < 12 and 12 < np.std(one) < 34  # 700 draws of 0, 1, 2: sd 21.6


def test_three_blocks_are_drawn_evenly(spark):
    cells = spark.createDataFrame([("a", i, 10**i, 1, 0, 1) for i in range(3)], "grp string, cell long, k1 long, n1 long, k2 long, n2 long")
    got = Counter(r["k1"] for r in sample.bootstrap_sums(cells, ["grp"], 5400, 9).collect())
    expected = {300: 200, 30: 200, 3: 200, 210: 600, 201: 600, 120: 600, 21: 600, 102: 600, 12: 600, 111: 1200}
    assert set(got) == set(expected)
    assert sum((got[k] - n) ** 2 / n for k, n in expected.items()) < 30  # chi-squared of 9 degrees


def test_draws_split_by_halves_add_up():
    rng = np.random.default_rng(1)
    made = sample.split_draws(np.full(4000, 10), np.array([1, 0, 3, 4]), rng)
    assert (made.sum(axis=1) == 10).all() and (made[:, 1] == 0).all()
    assert np.allclose(made.mean(axis=0), [1.25, 0, 3.75, 5], atol=0.15)


def test_bootstrap_without_overlap(spark):
    cells = spark.createDataFrame([("a", 1, 1, 2, 0, 0), ("b", 1, 1, 2, 1, 4), ("b", 2, 0, 2, 1, 4)], "grp string, cell long, k1 long, n1 long, k2 long, n2 long")
    got = {r["grp"]: r for r in sample.block_bootstrap(cells, ["grp"], 50).collect()}
    assert got["a"]["status"] == "insufficient_overlap" and got["a"]["low"] is None and got["a"]["blocks"] == 0
    assert got["b"]["status"] == "available" and got["b"]["observed"] == 0.0 and got["b"]["p_positive"] + got["b"]["p_negative"] <= 1


def test_bootstrap_covers(spark):
    cells = spark.createDataFrame([("g", c, 30 + c % 3, 60, 20 + c % 2, 60) for c in range(40)], "grp string, cell long, k1 long, n1 long, k2 long, n2 long")
    r = sample.block_bootstrap(cells, ["grp"], 200).first()
    assert r["low"] <= 31 / 60 - 20.5 / 60 <= r["high"] and r["p_positive"] == 1


def test_orientation_null(spark):
    seen = spark.createDataFrame([(3600, 200, 40, 470)], "n long, wide long, core long, peak long")
    got = {r["band"]: r for r in sample.orientation_null(seen, 400).collect()}
    assert got["wide"]["expected"] == pytest.approx(120, rel=0.03) and got["core"]["expected"] == pytest.approx(40, rel=0.06) and 400 < got["peak"]["expected"] < 480
    assert got["wide"]["p"] == 1 / 401 and 0.3 < got["core"]["p"] < 0.7 and got["peak"]["p"] < 0.2


def test_moran_permutation(spark):
    n = 60
    edges = [(i, j) for i in range(n) for j in ((i + 1) % n, (i - 1) % n)]
    table = spark.createDataFrame(edges, "id long, id2 long")

    def moran(v):
        m = sum(v) / n
        return n / len(edges) * sum((v[a] - m) * (v[b] - m) for a, b in edges) / sum((x - m) ** 2 for x in v)

    for v in ([float(i < 15) for i in range(n)], [float(i % 4 == 0) for i in range(n)]):
        r = sample.moran_permutation(spark.createDataFrame(list(enumerate(v)), "id long, v double"), table, 200).first()
        assert r["moran_i"] == pytest.approx(moran(v)) and (r["n"], r["edges"]) == (n, len(edges))
        assert r["expected"] == pytest.approx(-1 / (n - 1), abs=0.03)
        assert r["p"] == 1 / 201 if v[0] and v[1] else r["p"] > 0.9


def test_attributions_that_do_not_count(spark):
    text = ["Stained glass window designed by Harry Lane.", "built by the Parochial Board", "designed by Sir Aston", "To designs by W.H. Lynn. Comprising a hall", "designed by Rose and Son", "designed by an architect named only as Murphy, 1870", "designed by Murphy"]
    got = values(spark, text, lambda c: evidence.attribution(c)["name"])
    assert got == [None, None, None, "W.H. Lynn", None, "Murphy", None]


def test_durations(spark):
    text = ["1:30", "0:05:07", "100:00", "1:60", "1:5", "2 h 30 min", "90 min", "1h1m1s", "45 s", "30 min 1 h", "1.5 hours", "1..5 h", "5", "", None, "0:00", "1 h x", "7 m 7 m"]
    assert values(spark, text, limits.duration) == [5400, 307, 360000, None, None, 9000, 5400, 3661, 45, None, 5400, None, None, None, None, None, None, None]


def test_cloud_null_against_a_plain_simulation(spark):
    rng = random.Random(2)
    rows = [(i, rng.uniform(0, 60), rng.uniform(-20, 40)) for i in range(60)]
    points = spark.createDataFrame([*rows, (99, None, 1.0)], "id long, x double, y double")
    near = F.abs(F.col("d") - 4) < 1.5
    got = sample.cloud_null(points, near, Scratch(spark, "c"), iterations=12, seed=3).first()
    frame = spark.createDataFrame([(min(r[1] for r in rows), max(r[1] for r in rows), min(r[2] for r in rows), max(r[2] for r in rows), 60)], "x0 double, x1 double, y0 double, y1 double, n long")
    made = [(r["iteration"], r["x"], r["y"]) for r in sample.clouds(frame, 12, 3).collect()]

    def share(xy):
        d = [min(math.hypot(a - c, b - e) for j, (c, e) in enumerate(xy) if j != i) for i, (a, b) in enumerate(xy)]
        return sum(abs(x - 4) < 1.5 for x in d) / len(d)

    null = [share([(x, y) for i, x, y in made if i == k]) for k in range(12)]
    seen = share([r[1:] for r in rows])
    assert got["n"] == 60 and got["observed"] == pytest.approx(seen) and got["expected"] == pytest.approx(sum(null) / 12)
    assert got["p"] == pytest.approx((1 + sum(x >= seen - 1e-12 for x in null)) / 13)
    xs = np.array([x for i, x, _ in made if i == 0])
    assert 0 <= xs.min() < 6 and 54 < xs.max() <= 60 and len(made) == 720
    none = sample.cloud_null(points.limit(0), near, Scratch(spark, "c"), iterations=3).first()
    assert none["n"] == 0 and none["p"] is None


def test_differences_find_what_was_planted(spark):
    schema = "g string, k int, p double, verdict string"
    rows = [("a", 1, 0.5, "SIGNAL"), ("a", 2, None, "background"), ("b", None, float("nan"), None), (None, 3, 0.1, "x"), ("c", 9, 0.2, "x")]
    left = spark.createDataFrame(rows, schema)
    same = spark.createDataFrame([(g, k, p and p + 1e-9, v) for g, k, p, v in rows], schema)
    assert quality.differences(left, same, ["g", "k"], {"p": 1e-6, "verdict": None}).count() == 0
    other = [("a", 1, 0.6, "background"), ("a", 2, 0.0, "background"), ("b", None, float("nan"), None), (None, 3, 0.1, "x"), ("d", 1, 0.2, "x"), ("d", 1, 0.2, "x")]
    got = {r["what"]: (r["n"], [(s["key"], s["left"], s["right"]) for s in r["samples"]]) for r in quality.differences(left, spark.createDataFrame(other, schema), ["g", "k"], {"p": 1e-6, "verdict": None}).collect()}
    assert got == {
        "p": (2, [("a|1", "0.5", "0.6"), ("a|2", None, "0.0")]),
        "verdict": (1, [("a|1", "SIGNAL", "background")]),
        "left only": (1, [("c|9", None, None)]),
        "right only": (2, [("d|1", None, None)] * 2),
        "right repeated": (1, [("d|1", None, None)]),
    }


@pytest.mark.parametrize("bound", [100_000, 5])
def test_strict_match_against_a_plain_version(spark, monkeypatch, bound):
    monkeypatch.setattr(spatial.assign_once, "__defaults__", (1, "stratum", bound))
    rng = random.Random(7)
    covariates = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", "", None]), rng.choice([1.0, 2.0, None])) for i in range(70)]
    pairs = [(i, c, round(rng.random(), 2)) for i in range(30) for c in rng.sample(range(30, 72), 8)]
    known = {i: (s or "unknown", e or None, score or 0.0) for i, s, e, score in covariates}
    options = {}
    for i, c, cost in pairs:
        if c in known and known[i][0] == known[c][0]:
            gap = bool(known[i][1] and known[c][1] and known[i][1] != known[c][1])
            options.setdefault(i, []).append((cost + 0.25 * gap, c, gap))
    used, expected = set(), set()
    for i in sorted(options, key=lambda i: (len(options[i]), -known[i][2], i)):
        free = [x for x in sorted(options[i]) if x[1] not in used][:2]
        used |= {c for _, c, _ in free}
        expected |= {(known[i][0], i, c, round(cost, 6), rank, gap) for rank, (cost, c, gap) in enumerate(free, 1)}
    got = spatial.strict_match(spark.createDataFrame(pairs, "id long, cid long, cost double"), spark.createDataFrame(covariates, "id long, stratum string, era string, score double"), Scratch(spark, "s"), 2)
    assert {(r["stratum"], r["id"], r["cid"], round(r["cost"], 6), r["rank"], r["era_gap"]) for r in got.collect()} == expected
    one = spatial.strict_summary(spark.range(30), got, 2).first()
    per = Counter(x[1] for x in expected)
    assert tuple(one) == (30, sum(n == 2 for n in per.values()), sum(n == 1 for n in per.values()), 30 - len(per), len(expected), len(used))


def test_cloud_distances_need_no_tree(spark):
    """Evenly spread points find their nearest by cells, in few rounds, as all pairs have it."""
    frame = spark.createDataFrame([(0.0, 100.0, 0.0, 5.0, 300)], "x0 double, x1 double, y0 double, y1 double, n long")
    made = Scratch(spark, "c").save(sample.clouds(frame, 3, 4), "clouds")
    scratch = Scratch(spark, "even")
    got = {r["id"]: r["d"] for r in sample._even_nearest(made, 100.0, 5.0, 300, scratch).collect()}
    rows = [tuple(r) for r in made.collect()]
    want = {i: min(math.hypot(x - u, y - v) for c2, j, u, v in rows if c2 == c and j != i) for c, i, x, y in rows}
    assert len(rows) == len(got) == 900 and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert len(scratch.saved) <= 8
