"""Searches in blocks of origins against a plain search: batches that cut a key, hot nodes, states, departures, ties and ways along labels."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import graph
from fathomline.sources.store import Scratch

EDGES, STARTS = "u long, v long, w double, ferry long", "origin long, node long, start double"


def made(seed, n, m):
    rng = random.Random(seed)
    hot = [(rng.randrange(n), 0, float(rng.randint(1, 9)), -1) for _ in range(200)]
    return hot + [(rng.randrange(n), rng.randrange(n), float(rng.randint(0, 20)), rng.choice([-1, -1, 3, 4])) for _ in range(m)]


def plain(edges, node, start, after):
    """Least (cost, hops, prev) by (node, state)."""
    ways = {}
    for e in edges:
        ways.setdefault(e[0], []).append(e)
    out, heap = {}, [((start, 0, -1), (node, -1))]
    while heap:
        label, at = heapq.heappop(heap)
        if at not in out:
            out[at] = label
            for _, v, w, ferry in ways.get(at[0], ()):
                cost, state = after(label[0], w, ferry, at[1])
                heapq.heappush(heap, ((cost, label[1] + 1, at[0]), (v, state)))
    return out


@pytest.fixture
def small(spark, monkeypatch):
    """A few origins a block and a few rows a batch."""
    monkeypatch.setattr(graph, "BLOCK", 4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_labels_and_ways_along_them(small):
    edges = made(1, 80, 160)
    starts = [(i, i * 3, float(i)) for i in range(11)] + [(5, 70, 2.0), (12, 1_000, 0.0)]
    labels = graph.shortest(small.createDataFrame(edges, EDGES), small.createDataFrame(starts, STARTS), Scratch(small, "b"))
    want = {}
    for origin, node, start in starts:
        for (v, _), label in plain(edges, node, start, lambda c, w, f, s: (c + w, -1)).items():
            want[origin, v] = min(want.get((origin, v), (float("inf"),)), label)
    rows = labels.collect()
    assert {(r["origin"], r["node"]): (r["cost"], r["hops"], -1 if r["prev"] is None else r["prev"]) for r in rows} == want and len(rows) == len(want)
    least = {}
    for u, v, w, _ in edges:
        least[u, v] = min(w, least.get((u, v), w))
    begun = {(o, n): s for o, n, s in starts}
    traced = graph.along(labels, Scratch(small, "a"), {"n": (F.lit(0), F.col("n") + 1)}).collect()
    assert len(traced) == len(rows)
    for r in traced:
        assert r["path"][-1] == r["node"] and r["n"] == r["hops"] == len(r["path"]) - 1
        assert begun[r["origin"], r["path"][0]] + sum(least[x] for x in zip(r["path"], r["path"][1:])) == r["cost"]


def test_states_and_departures(small):
    edges = made(2, 60, 150)
    starts = [(i, i * 5, 0.0) for i in range(9)]
    state, boards = F.col("state"), (F.col("ferry") >= 0) & (F.col("ferry") != F.col("state"))
    e, s = small.createDataFrame(edges, EDGES), small.createDataFrame(starts, STARTS)
    got = graph.shortest(e, s, Scratch(small, "b"), state=(F.lit(-1).cast("long"), F.col("ferry")), departs=F.when(boards, 15), costs_only=True)
    after = lambda c, w, f, s: ((np.ceil(c / 15) * 15 if f >= 0 and f != s else c) + w, f)
    want = {(o, v, k): label[0] for o, n, c in starts for (v, k), label in plain(edges, n, c, after).items()}
    rows = got.collect()
    assert {(r["origin"], r["node"], r["state"]): r["cost"] for r in rows} == want and len(rows) == len(want)
    # states that are structs, and edges that may not be taken
    wide = (F.struct(F.lit(-1).cast("long").alias("f"), F.array(F.lit(1)).alias("x")), F.struct(F.col("ferry").alias("f"), F.array(F.lit(1)).alias("x")))
    got = graph.shortest(e, s, Scratch(small, "b"), state=wide, passes=(state["f"] != 3) | (F.col("ferry") != 4), costs_only=True)
    shut = lambda c, w, f, s: (float("inf") if s == 3 and f == 4 else c + w, f)
    want = {(o, v, k): label[0] for o, n, c in starts for (v, k), label in plain(edges, n, c, shut).items() if label[0] < float("inf")}
    assert {(r["origin"], r["node"], r["state"]["f"]): r["cost"] for r in got.collect()} == want


def test_rows_hold_blocks_of_origins(small):
    scratch = Scratch(small, "b")
    edges = [(i, (i + 1) % 30, 1.0, -1) for i in range(30)]
    got = graph.shortest(small.createDataFrame(edges, EDGES), small.createDataFrame([(i, i, 0.0) for i in range(30)], STARTS), scratch, costs_only=True)
    assert got.count() == 900
    last = max((t for t in scratch.saved if t.startswith("labels")), key=lambda t: int(t[6:]))
    assert small.read.parquet(scratch.path(last)).count() <= 900 / 2
    assert graph.shortest(small.createDataFrame(edges, EDGES), small.createDataFrame([], STARTS), Scratch(small, "b"), costs_only=True).count() == 0
    with pytest.raises(ValueError, match="not be negative"):
        graph.shortest(small.createDataFrame([(1, 2, -1.0, -1), (2, 1, 0.0, -1)], EDGES), small.createDataFrame([(1, 1, 0.0)], STARTS), Scratch(small, "b"))
