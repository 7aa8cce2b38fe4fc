"""Pair searches against a plain search over random graphs."""

import heapq
import random

import numpy as np
import pytest

from fathomline.operators import graph as paths
from fathomline.operators import pairs
from fathomline.sources.store import Scratch


def graph(seed, n, m, top=20):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), float(rng.randint(0, top))) for _ in range(m)]


def distances(edges, origin):
    out, heap, ways = {}, [(0.0, origin)], {}
    for u, v, w in edges:
        ways.setdefault(u, []).append((v, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u not in out:
            out[u] = d
            for v, w in ways.get(u, ()):
                heapq.heappush(heap, (d + w, v))
    return out


@pytest.mark.parametrize("seed, width", [(1, 0.0), (2, 15.0), (3, 1e9)])
def test_costs_and_routes(spark, seed, width):
    rng = random.Random(seed)
    edges = graph(seed, 120, 260)
    wanted = [(rng.randrange(120), rng.randrange(120)) for _ in range(25)] + [(5, 5), (5, 10_000), (None, 3), (2, None)]
    found = pairs.search(spark.createDataFrame(edges, "u long, v long, w double"), spark.createDataFrame(wanted + wanted[:3], "origin long, destination long"), Scratch(spark, "p"), width)
    got = {(r["origin"], r["destination"]): r["cost"] for r in found.costs.collect()}
    assert got == {(a, b): None if a is None else 0.0 if a == b else distances(edges, a).get(b) for a, b in wanted}
    least = {}
    for u, v, w in edges:
        least[u, v] = min(w, least.get((u, v), w))
    ends = {r["pair"]: (r["origin"], r["destination"], r["cost"]) for r in found.costs.collect()}
    traced = pairs.routes(found, Scratch(spark, "t")).collect()
    assert len(traced) == sum(c is not None for c in got.values())
    for r in traced:
        a, b, cost = ends[r["pair"]]
        assert r["path"][0] == a and r["path"][-1] == b
        assert sum(least[u, v] for u, v in zip(r["path"], r["path"][1:])) == cost


def test_a_search_stays_near_its_ends(spark):
    side = 40
    node = lambda i, j: i * side + j
    edges = [(node(i, j), node(i + a, j + b), 10.0) for i in range(side) for j in range(side) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < side and 0 <= j + b < side]
    wanted = [(node(20, 18), node(20, 22)), (node(3, 3), node(6, 3))]
    found = pairs.search(spark.createDataFrame(edges, "u long, v long, w double"), spark.createDataFrame(wanted, "origin long, destination long"), Scratch(spark, "p"), 10.0)
    assert sorted(r["cost"] for r in found.costs.collect()) == [30.0, 40.0]
    assert found.labels.count() < 100 < len(wanted) * side * side / 10


def test_bounds(spark):
    edges = spark.createDataFrame(graph(4, 10, 30), "u long, v long, w double")
    ends = spark.range(6).selectExpr("id AS origin", "id AS destination")
    with pytest.raises(ValueError, match="at most 25"):
        pairs.matrix(edges, ends, ends, Scratch(spark, "p"), 10.0)
    with pytest.raises(ValueError, match="at most 5"):
        pairs.search(edges, ends, Scratch(spark, "p"), 10.0, most=5)
    few = ends.where("origin < 5")
    assert pairs.matrix(edges, few, few, Scratch(spark, "p"), 10.0).costs.count() == 25
    assert pairs.search(edges.limit(0), few.limit(0), Scratch(spark, "p"), 1.0).costs.count() == 0


def test_chains_of_ways(spark):
    ways = spark.createDataFrame([(1, [10, 11, 12]), (2, [12, 13]), (3, [14, 13]), (4, [12, 10]), (5, []), (6, [20, 20]), (7, [20, 12]), (8, None)], "way long, nodes array<long>")
    rules = [("two", [1, 2]), ("three", [1, 2, 3]), ("loop", [1, 4]), ("apart", [1, 3]), ("later apart", [1, 2, 1, 3]), ("empty way", [1, 5]), ("unknown", [1, 99]), ("null way", [1, 2, None]), ("alone", [1]), ("none", []), ("circle", [6, 7]), ("no nodes", [8, 1])]
    got = {r["rule"]: (r["status"], r["via_node"], r["junctions"]) for r in paths.chains(spark.createDataFrame(rules, "rule string, members array<long>"), ways).collect()}
    assert got["two"] == ("ok", 12, [12]) and got["three"] == ("ok", 13, [12, 13]) and got["circle"] == ("ok", 20, [20])
    assert {k for k, v in got.items() if v[0] == "unsupported"} == {"loop", "apart", "later apart"}
    assert {k for k, v in got.items() if v[0] == "unresolved"} == {"empty way", "unknown", "null way", "alone", "none", "no nodes"}


def test_many_labels_of_a_pair(spark):
    """Searches of more labels than a packed row holds, several per task and some without a way, carry their ways and need not list their labels."""
    edges = graph(9, 9_000, 20_000, 97)
    wanted = [(i, 8_999 - 7 * i) for i in range(12)] + [(20_000, 5), (3, 20_000)]
    found = pairs.search(spark.createDataFrame(edges, "u long, v long, w double"), spark.createDataFrame(wanted, "origin long, destination long"), Scratch(spark, "p"), 60.0, labels=False)
    assert found.labels is None
    least = {}
    for u, v, w in edges:
        least[u, v] = min(w, least.get((u, v), w))
    for r in found.costs.collect():
        assert r["cost"] == distances(edges, r["origin"]).get(r["destination"])
        if r["cost"] is not None:
            assert r["path"][0] == r["origin"] and r["path"][-1] == r["destination"] and r["meeting"] in r["path"]
            assert sum(least[u, v] for u, v in zip(r["path"], r["path"][1:])) == r["cost"]
    x = pairs._Labels(np.arange(1300) % 2, np.arange(1300) % 3 == 0, np.arange(1300) - 50, np.arange(1300) / 8, np.arange(1300) * 2**40)
    back = pairs._Labels.joined([pairs._Labels.unpacked(row) for row in x.packed()])
    assert all((getattr(back, c) == getattr(x, c)).all() for c in ("side", "open", "node", "cost", "prev"))
