"""Searches within tasks against plain ones and against the distributed ones that larger graphs take."""

import datetime as dt
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_conditional import open_at

from fathomline.operators import graph, near, pairs
from fathomline.plans import calendars, registry
from fathomline.sources.store import Scratch

EDGES, STARTS = "u long, v long, w double, ferry long", "origin long, node long, start double"
GRAPH_QUERIES = ["od_matrix", "conditional_paths", "profile_compare", "profile_paths", "route_response", "restricted_turns", "route_segments", "rule_provenance", "two_quantities", "timed_paths", "via_way_turns", "tagged_paths"]


def made(seed, n, m, apart=1):
    rng = random.Random(seed)
    hot = [(rng.randrange(n) * apart, 0, float(rng.randint(1, 9)), -1) for _ in range(50)]
    return hot + [(rng.randrange(n) * apart, rng.randrange(n) * apart, rng.choice([0.0, 0.1, 2.5, 7.0, 20.0]), rng.choice([-1, -1, 3, 4])) for _ in range(m)]


def plain(edges, node, start, after, begin=None):
    """Costs of (node, state) in the order of arrival."""
    ways = {}
    for e in edges:
        ways.setdefault(e[0], []).append(e)
    out, heap = {}, [(start, node, begin)]
    while heap:
        cost, at, state = heapq.heappop(heap)
        if (at, state) not in out:
            out[at, state] = cost
            for e in ways.get(at, ()):
                if (got := after(cost, e, state)) is not None:
                    heapq.heappush(heap, (got[0], e[1], got[1]))
    return out


@pytest.fixture(params=[1, 1_000])
def labels(request, monkeypatch):
    """One origin at a time, some together."""
    monkeypatch.setattr(near, "LABELS", request.param)
    monkeypatch.setattr(near, "ROWS", 7)


@pytest.mark.parametrize("apart", [1, 1_000_003])
def test_costs(spark, labels, apart):
    edges = made(1, 80, 160, apart)
    starts = [(i, i * 3 * apart, float(i)) for i in range(11)] + [(5, 70 * apart, 2.0), (12, -77, 0.5)]
    scratch = Scratch(spark, "n")
    got = near.costs(spark.createDataFrame(edges, EDGES), spark.createDataFrame(starts, STARTS), scratch).collect()
    want = {}
    for origin, node, start in starts:
        for (v, _), cost in plain(edges, node, start, lambda c, e, s: (c + e[2], s)).items():
            want[origin, v] = min(want.get((origin, v), np.inf), cost)
    assert {(r["origin"], r["node"]): r["cost"] for r in got} == want and len(got) == len(want)
    assert not any(t.startswith("labels") for t in scratch.saved)  # no table of labels between rounds


def test_states_and_departures(spark, labels):
    edges = made(2, 60, 150)
    e, s = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(i, i * 5, 0.0) for i in range(9)], STARTS)
    boards = (F.col("ferry") >= 0) & (F.col("ferry") != F.col("state"))
    ask = {"state": (F.lit(-1).cast("long"), F.col("ferry")), "departs": F.when(boards, 15), "passes": (F.col("state") != 3) | (F.col("ferry") != 4)}
    got = near.costs(e, s, Scratch(spark, "n"), **ask).collect()

    def after(cost, edge, state):
        if state == 3 and edge[3] == 4:
            return None
        return (np.ceil(cost / 15) * 15 if edge[3] >= 0 and edge[3] != state else cost) + edge[2], edge[3]

    want = {}
    for i in range(9):
        for (v, _), cost in plain(edges, i * 5, 0.0, after, -1).items():
            want[i, v] = min(want.get((i, v), np.inf), cost)
    assert {(r["origin"], r["node"]): r["cost"] for r in got} == want and len(got) == len(want)


def test_second_quantity_and_ways(spark, labels):
    rng = random.Random(3)
    edges = list({(u, v): (u, v, float(rng.randint(0, 3)), rng.randint(0, 2)) for u, v in ((rng.randrange(40), rng.randrange(40)) for _ in range(120))}.values())
    e, s = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(i, i * 4, 0.0) for i in range(8)], STARTS)
    got = near.two_quantities(e, s, Scratch(spark, "n"), "ferry").collect()
    want = {(r["origin"], r["node"]): (r["cost"], r["second"]) for r in graph.shortest(e, s, Scratch(spark, "g"), second="ferry").collect()}
    assert {(r["origin"], r["node"]): (r["cost"], r["second"]) for r in got} == want and len(got) == len(want)
    make = lambda g, cost, nodes, taken: {"node": g.name[nodes], "path": near.joined(g, nodes, taken, ">"), "w": g.more["w"][taken].sum(axis=1).astype(float)}
    ways = near.routes(e.select("u", "v", "w"), s, Scratch(spark, "n"), make, "node long, path string, w double").collect()
    along = graph.along(graph.shortest(e, s, Scratch(spark, "g")), Scratch(spark, "a")).collect()
    assert {(r["origin"], r["node"]): (r["path"], r["w"]) for r in ways} == {(r["origin"], r["node"]): (">".join(map(str, r["path"])), r["cost"]) for r in along} and len(ways) == len(along)


def test_matrix(spark, labels):
    edges = made(4, 30, 25)
    s, d = spark.createDataFrame([(1, 1, 0.0), (2, 2, 0.0), (900, 900, 0.0)], STARTS), spark.createDataFrame([(0,), (3,), (900,), (12_345,), (-5,)], "node long")
    got = near.matrix(spark.createDataFrame(edges, EDGES).select("u", "v", "w"), s, d, Scratch(spark, "n")).collect()
    found = {o: plain(edges, o, 0.0, lambda c, e, _: (c + e[2], None)) for o in (1, 2, 900)}
    assert sorted((r["origin"], r["node"], -1 if r["cost"] is None else r["cost"]) for r in got) == sorted((o, n, found[o].get((n, None), -1)) for o in found for n in (0, 3, 900, 12_345, -5))


def test_later_arrivals_may_find_open_what_earlier_ones_do_not(spark, labels):
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randint(10, 60)), rng.randrange(4)) for _ in range(150)]
    speeds = {(k, slot): rng.choice([None, 1.0, 0.5]) for k in range(4) for slot in range(3 + 5)}
    rules = spark.createDataFrame([(*at, speed) for at, speed in speeds.items()], "kind long, slot long, speed double")
    e, s = spark.createDataFrame(edges, "u long, v long, w double, kind long"), spark.createDataFrame([(i, i * 5, 0.0) for i in range(8)], STARTS)
    got = near.arrivals(e, s, Scratch(spark, "n"), rules, 7.0, 3, 5, lambda t, w, speed: t + w / speed, 10.0).collect()

    def after(cost, edge, state):
        slot = int(cost // 7)
        speed = speeds[edge[3], slot if slot < 3 else 3 + (slot - 3) % 5]
        return speed and (cost + edge[2] / speed, state)

    want = {(i, v): cost for i in range(8) for (v, _), cost in plain(edges, i * 5, 0.0, after).items()}
    assert {(r["origin"], r["node"]): r["cost"] for r in got} == want and len(got) == len(want)


def test_what_does_not_fit_a_task_is_distributed(spark, monkeypatch):
    edges = made(6, 30, 60)
    e, s = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(i, i * 5, 0.0) for i in range(5)], STARTS)
    ask = {"state": (F.lit(-1).cast("long"), F.col("ferry")), "departs": F.when(F.col("ferry") != F.col("state"), 15)}
    rows = lambda df: sorted(map(tuple, df.collect()))
    search = lambda **how: rows(near.costs(e, s, Scratch(spark, "n"), **how))
    there = search(), search(**ask)
    monkeypatch.setattr(near, "MOST_EDGES", 10)
    assert (search(), search(**ask)) == there
    assert near.pack(e, s, Scratch(spark, "n")) is None
    monkeypatch.undo()
    with pytest.raises(ValueError, match="not be negative"):
        near.costs(spark.createDataFrame([(1, 2, -1.0, -1)], EDGES), s, Scratch(spark, "n"))
    assert near.costs(e, spark.createDataFrame([], STARTS), Scratch(spark, "n")).count() == 0
    assert near.costs(e.limit(0), s, Scratch(spark, "n")).count() == 5


@pytest.mark.parametrize("name", GRAPH_QUERIES)
def test_queries_search_in_tasks(spark, sf_dir, monkeypatch, name):
    """No query writes labels round by round while its edges fit."""

    def refused(*args, **kwargs):
        raise AssertionError("a distributed search over a small graph")

    monkeypatch.setattr(graph, "shortest", refused)
    assert len(registry.queries()[name](spark, sf_dir).schema)


def test_weeks_are_alike_behind_the_dates_of_tags():
    start, week = dt.datetime.fromisoformat(calendars.START) + dt.timedelta(days=calendars.DATED), dt.timedelta(days=7)
    assert max(dt.date.fromisoformat(d) for d in calendars.DAYS_OFF) < start.date()
    for minute in range(0, 7 * 1440, 7):
        t = start + dt.timedelta(minutes=minute)
        assert [open_at(k, t, False) for k in range(7)] == [open_at(k, t + week, False) for k in range(7)] == [open_at(k, t + 60 * week, False) for k in range(7)]
    assert any(open_at(5, start - dt.timedelta(days=2, minutes=m), False) != open_at(5, start - dt.timedelta(days=2, minutes=m) + week, False) for m in range(0, 1440, 30))


@pytest.mark.parametrize("width", [0.5, 30.0])
def test_pairs(spark, monkeypatch, width):
    rng = random.Random(7)
    edges = [e[:3] for e in made(8, 150, 320, 11)]
    wanted = [(rng.randrange(150) * 11, rng.randrange(150) * 11) for _ in range(60)] + [(55, 55), (55, 10_000), (10_001, 10_001), (None, 33), (22, None)]
    e, w = spark.createDataFrame(edges, "u long, v long, w double"), spark.createDataFrame(wanted + wanted[:3], "origin long, destination long")
    search = pairs.search
    monkeypatch.setattr(pairs, "search", None)  # labels between rounds
    rows = near.pair_search(e, w, Scratch(spark, "n"), width).costs.collect()
    want = {(a, b): None if a is None else plain(edges, a, 0.0, lambda c, e, _: (c + e[2], None)).get((b, None)) for a, b in wanted}
    least = {}
    for u, v, x in edges:
        least[u, v] = min(x, least.get((u, v), x))
    assert {r["origin"] for r in rows} == {a for a, _ in wanted} and len(rows) == len(want)
    for r in rows:
        cost = want[r["origin"], r["destination"]]
        assert (r["cost"] is None) == (cost is None) == (r["path"] is None)
        if cost is not None:
            assert r["cost"] == pytest.approx(cost, abs=1e-9) and (r["path"][0], r["path"][-1]) == (r["origin"], r["destination"])
            assert sum(least[x] for x in zip(r["path"], r["path"][1:])) == pytest.approx(cost, abs=1e-9)
    monkeypatch.setattr(pairs, "search", search)
    monkeypatch.setattr(near, "MOST_EDGES", 10)
    far = near.pair_search(e, w, Scratch(spark, "n"), width).costs.collect()
    assert sorted((str(r["pair"]), r["cost"] and round(r["cost"], 6)) for r in far) == sorted((str(r["pair"]), r["cost"] and round(r["cost"], 6)) for r in rows)


@pytest.mark.parametrize("name", ["pair_costs", "pair_routes", "routing_summary"])
def test_pairs_are_searched_in_tasks(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(pairs, "search", None)
    assert len(registry.queries()[name](spark, sf_dir).schema)
