"""Searches that go ahead of the order of arrival, against a plain search: edges closed at times, labels taken back, circles that nothing reaches."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import graph
from fathomline.sources.store import Scratch

EDGES, STARTS = "u long, v long, w double, shut long", "origin long, node long, start double"


def plain(edges, node, start):
    ways = {}
    for e in edges:
        ways.setdefault(e[0], []).append(e)
    best, heap = {}, [(start, node)]
    while heap:
        t, at = heapq.heappop(heap)
        if at not in best:
            best[at] = t
            for _, v, w, shut in ways.get(at, ()):
                if not (shut and t // shut % 2):
                    heapq.heappush(heap, (t + w, v))
    return best


def search(spark, edges, starts, scratch):
    t = F.col("cost")
    passes = (F.col("shut") == 0) | (F.floor(t / F.nullif(F.col("shut"), F.lit(0))) % 2 == 0)
    return graph.shortest(spark.createDataFrame(edges, EDGES), spark.createDataFrame(starts, STARTS), scratch, passes=passes, least=1.0, cost="w", ahead=True)


def check(spark, edges, starts, scratch):
    rows = search(spark, edges, starts, scratch).collect()
    want = {(o, v): c for o, n, s in starts for v, c in plain(edges, n, s).items()}
    assert {(r["origin"], r["node"]): r["cost"] for r in rows} == want and len(rows) == len(want)


def test_arrivals_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_TABLES", 4)
    rng, turns = random.Random(7), []
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randint(1, 90)), rng.choice([0, 0, 7, 30])) for _ in range(110)]
    scratch = Scratch(spark, "ahead")
    save = scratch.save_counted
    monkeypatch.setattr(scratch, "save_counted", lambda df, name: (turns.append(name), save(df, name))[1])
    check(spark, edges, [(i, i, float(i)) for i in range(0, 12, 3)], scratch)
    # in the order of costs, by steps of 1, it would take more than a hundred
    assert sum(name.startswith("found") for name in turns) <= 30


def test_circles_that_keep_each_other_up(spark, monkeypatch):
    monkeypatch.setattr(graph, "GIVEN_UP", 8)
    # node 2 is reached at 9 first and at 5 later; 2 to 3 is open at 9 only, and 3, 4 and 5 are a circle behind it
    edges = [(1, 2, 9.0, 0), (1, 6, 2.0, 0), (6, 7, 1.0, 0), (7, 2, 2.0, 0), (2, 3, 1.0, 4), (3, 4, 1.0, 0), (4, 5, 1.0, 0), (5, 3, 1.0, 0), (2, 8, 1.0, 0), (8, 2, 1.0, 0)]
    check(spark, edges, [(1, 1, 0.0)], Scratch(spark, "ahead"))
    with pytest.raises(ValueError, match="positive"):
        graph.shortest(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(1, 1, 0.0)], STARTS), Scratch(spark, "ahead"), least=0.0, ahead=True)
