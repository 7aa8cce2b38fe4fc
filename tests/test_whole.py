"""Queries against plain versions of the whole job."""

import heapq

from fathomline.operators import graph
from fathomline.plans import graphs, registry, spatial
from fathomline.sources.store import Scratch

import pytest

QUERIES = registry.queries()


def dijkstra(ways, start, cost=0.0, step=lambda t, e: t + e["w"]):
    """Least costs by node; ways: node to rows with v."""
    best, heap = {}, [(cost, start)]
    while heap:
        t, node = heapq.heappop(heap)
        if node not in best:
            best[node] = t
            for e in ways.get(node, ()):
                heapq.heappush(heap, (step(t, e), e["v"]))
    return best


def leaving(rows):
    out = {}
    for r in rows:
        out.setdefault(r["u"], []).append(r)
    return out


def origins(spark, sf_dir):
    return [r["origin"] for r in graphs._origins(spark, sf_dir).collect()]


def costs(rows, value="cost"):
    return {(r["origin"], r["node"]): r[value] for r in rows}


def expected(spark, sf_dir, ways, **how):
    return {(o, node): t for o in origins(spark, sf_dir) for node, t in dijkstra(ways, o, **how).items()}


def test_od_matrix(spark, sf_dir):
    """Every hundredth customer with every one fifty off, each with its least cost, null where there is no way."""
    ways = leaving(graphs.edges(spark, sf_dir).collect())
    keys = [r[0] for r in registry.table(spark, sf_dir, "customer").select("c_custkey").collect()]
    ends = [k for k in keys if k % 100 == 50]
    got = costs(QUERIES["od_matrix"](spark, sf_dir).collect())
    best = {o: dijkstra(ways, o) for o in keys if o % 100 == 0}
    assert got == {(o, d): best[o].get(d) for o in best for d in ends}
    assert any(v is not None for v in got.values())


def _open(rows, profile):
    fits = {"car": {0, 1, 2, 3, 4}, "van": {0, 1, 2, 4}, "lorry": {0, 2, 4}}[profile]
    return leaving(r for r in rows if r["cents"] % 5 in fits)


def test_profile_paths(spark, sf_dir):
    ways = _open(graphs.edges(spark, sf_dir).collect(), "lorry")
    assert costs(QUERIES["profile_paths"](spark, sf_dir).collect()) == expected(spark, sf_dir, ways)


def test_profile_compare_costs(spark, sf_dir):
    rows = graphs.edges(spark, sf_dir).collect()
    best = {p: expected(spark, sf_dir, _open(rows, p)) for p in graphs.PROFILES}
    got = QUERIES["profile_compare"](spark, sf_dir).collect()
    assert {r["profile"] for r in got} == set(graphs.PROFILES)
    for r in got:
        pair = r["origin"], r["node"]
        assert r["cost"] == best[r["profile"]][pair] and r["delta"] == r["cost"] - best["car"][pair]


def by_state(ways, start, first, go):
    """Least costs by node of a search whose state go(cost, state, edge) changes; None where it does not pass."""
    best, heap = {}, [(0.0, start, first)]
    while heap:
        t, node, state = heapq.heappop(heap)
        if (node, state) not in best:
            best[node, state] = t
            for e in ways.get(node, ()):
                if after := go(t, state, e):
                    heapq.heappush(heap, (after[0], e["v"], after[1]))
    out = {}
    for (node, _), t in best.items():
        out[node] = min(t, out.get(node, t))
    return out


def test_timed_paths(spark, sf_dir):
    def go(t, ferry, e):
        now = e["way"] if e["cents"] % 3 == 0 else -1
        return (-(-t // 900) * 900 if now >= 0 and now != ferry else t) + e["w"], now

    ways = leaving(graphs.edges(spark, sf_dir).collect())
    best = {(o, node): t for o in origins(spark, sf_dir) for node, t in by_state(ways, o, -1, go).items()}
    assert costs(QUERIES["timed_paths"](spark, sf_dir).collect(), "arrival") == best


def test_via_way_turns(spark, sf_dir):
    """Plain version: the state is the list of ways taken; a rule ends where its ways are the last ones."""

    def go(t, taken, e):
        if taken and taken[-1] == e["way"]:
            return t + e["w"], taken
        now = (*taken, e["way"])
        for first, only, to in graphs.CHAINS:
            begun = (first, *to[:-1])
            if taken[-len(begun) :] == begun:
                if only and e["way"] != to[-1] or not only and e["way"] == to[-1]:
                    return None
        return t + e["w"], now[-2:]

    ways = leaving(graphs.edges(spark, sf_dir).collect())
    best = {(o, node): t for o in origins(spark, sf_dir) for node, t in by_state(ways, o, (), go).items()}
    assert costs(QUERIES["via_way_turns"](spark, sf_dir).collect()) == best


def test_conditional_paths(spark, sf_dir):
    """Plain version: one search in the order of arrival."""

    def step(t, e):
        c = e["cents"]
        if c % 4 == 0 and t % 1800 < 600 and c % 6 != 0 or e["against"] and t // 3600 % 2 != 0:
            return None
        return t + (300 + e["w"]) * (2 if c % 5 == 0 and t % 3600 >= 1800 else 1)

    def go(t, state, e):
        after = step(t, e)
        return None if after is None else (after, state)

    ways = {}
    for r in graphs.edges(spark, sf_dir).collect():
        ways.setdefault(r["u"], []).append({**r.asDict(), "against": False})
        if r["cents"] % 7 == 0:
            ways.setdefault(r["v"], []).append({**r.asDict(), "v": r["u"], "against": True})
    best = {}
    for o in origins(spark, sf_dir):
        best |= {(o, node): t for node, t in by_state(ways, o, 0, go).items()}
    assert costs(QUERIES["conditional_paths"](spark, sf_dir).collect(), "arrival") == best


def test_restricted_turns(spark, sf_dir):
    rows = graphs.edges(spark, sf_dir).collect()
    out = leaving(rows)
    allowed = lambda a, b: b["way"] == 4 if a["way"] == 3 else not (a["way"] == 5 and b["way"] in (6, 7))
    turns = {a["id"]: [{"v": b["id"], "w": b["w"]} for b in out.get(a["v"], ()) if allowed(a, b)] for a in rows}
    best = {(r["id"], node): t for r in rows if r["id"] % 150 == 0 for node, t in dijkstra(turns, r["id"], float(r["w"])).items()}
    assert costs(QUERIES["restricted_turns"](spark, sf_dir).collect()) == best


def test_route_segments_costs(spark, sf_dir):
    rows = graphs.edges(spark, sf_dir).collect()
    best = expected(spark, sf_dir, leaving(rows))
    least = {}
    for r in rows:
        least[r["u"], r["v"]] = min(r["w"], least.get((r["u"], r["v"]), r["w"]))
    for r in QUERIES["route_segments"](spark, sf_dir).collect():
        path = [int(x) for x in r["path"].split(">")]
        assert path[0] == r["origin"] and path[-1] == r["node"] and len(path) == r["hops"] + 1
        assert sum(least[pair] for pair in zip(path, path[1:])) == r["cost"] == best[r["origin"], r["node"]]


def test_long_chain(spark):
    n = 60  # more edges than the old bounds of a search and of a trace
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "u long, v long, w double")
    labels = graph.shortest(e, spark.createDataFrame([(0, 0, 0.0)], "origin long, node long, start double"), Scratch(spark, "chain"))
    assert labels.count() == n + 1
    traced = graph.paths(labels, labels.where(f"node = {n}"), Scratch(spark, "chain"))
    assert traced.first()["path"] == list(range(n + 1))


def test_negative_circle(spark):
    e = spark.createDataFrame([(0, 1, -1.0), (1, 0, -1.0)], "u long, v long, w double")
    with pytest.raises(ValueError):
        graph.shortest(e, spark.createDataFrame([(0, 0, 0.0)], "origin long, node long, start double"), Scratch(spark, "circle"))


def test_profile_compare_whole(spark, sf_dir):
    rows = graphs.edges(spark, sf_dir).collect()
    best = {p: expected(spark, sf_dir, _open(rows, p)) for p in graphs.PROFILES}
    got = QUERIES["profile_compare"](spark, sf_dir).collect()
    assert {(r["profile"], r["origin"], r["node"]) for r in got} == {(p, *pair) for p, found in best.items() for pair in found}


def test_route_segments_whole(spark, sf_dir):
    best = expected(spark, sf_dir, leaving(graphs.edges(spark, sf_dir).collect()))
    got = QUERIES["route_segments"](spark, sf_dir).collect()
    assert len(got) == len(best) and {(r["origin"], r["node"]) for r in got} == set(best)


def test_holm_adjust_above_4000(spark, duck, tmp_path):
    duck.sql(f"COPY (SELECT * REPLACE (o_orderkey + 5000 AS o_orderkey) FROM orders) TO '{tmp_path}/orders.parquet'")
    families = {}
    for key, price in duck.sql("SELECT o_orderkey + 5000, o_totalprice FROM orders").fetchall():
        families.setdefault(key % 40, []).append((round(price * 100) % 1000 / 10000, key))
    expected = {}
    for family in families.values():
        most = 0.0
        for k, (p, key) in enumerate(sorted(family)):
            most = max(most, (len(family) - k) * max(p, 1e-300))
            expected[key] = min(1.0, most)
    got = {r["id"]: r["p_adjusted"] for r in QUERIES["holm_adjust"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(expected, abs=1e-11)


def test_union_edges_all(spark, sf_dir, duck):
    o = duck.sql("SELECT o_custkey, o_orderkey FROM orders").fetchall()
    expected = [(c, k, "forward") for c, k in o] + [(k, c, "backward") for c, k in o]
    expected += [(k, p, "ferry") for k, p in duck.sql("SELECT l_orderkey, l_partkey FROM lineitem").fetchall()]
    assert sorted(map(tuple, QUERIES["union_edges"](spark, sf_dir).collect())) == sorted(expected)


@pytest.fixture(scope="module")
def shapes(spark, sf_dir):
    """All points and a box (id, x0, y0, x1, y1) of each of them."""
    p = spatial.points(spark, sf_dir).collect()
    half = {r["id"]: r["area"] % 40 + 5 for r in p}
    return p, [(r["id"], r["x"] - half[r["id"]], r["y"] - half[r["id"]], r["x"] + half[r["id"]] + 7, r["y"] + half[r["id"]]) for r in p]


def _in(p, b):
    return b[1] <= p["x"] <= b[3] and b[2] <= p["y"] <= b[4]


def test_contain_else_near_all(spark, sf_dir, shapes):
    p, boxes = shapes
    expected = {}
    for b in boxes:
        met = []
        for r in p:
            d2 = (r["x"] - (b[1] + b[3]) / 2) ** 2 + (r["y"] - (b[2] + b[4]) / 2) ** 2
            if r["label"] % 3 == 0 and (_in(r, b) or d2 <= 2500):
                met.append((0 if _in(r, b) else 1, d2, r["id"]))
        if met:
            expected[b[0]] = min(met)
    assert {r["id"]: (r["mode"], r["d2"], r["pid"]) for r in QUERIES["contain_else_near"](spark, sf_dir).collect()} == expected


def test_point_in_first_feature_all(spark, sf_dir, shapes):
    p, boxes = shapes
    expected = {r["id"]: min((b[0] for b in boxes if _in(r, b)), default=None) for r in p}
    assert {r["id"]: r["seq"] for r in QUERIES["point_in_first_feature"](spark, sf_dir).collect()} == expected


def test_parts_in_footprint_all(spark, sf_dir, shapes):
    p, boxes = shapes
    inside = {b[0]: [r["area"] for r in p if _in(r, b)] for b in boxes}
    expected = {i: (len(areas), sum(areas), max(areas)) for i, areas in inside.items() if areas}
    assert {r["id"]: (r["n"], r["area"], r["highest"]) for r in QUERIES["parts_in_footprint"](spark, sf_dir).collect()} == expected


def test_nearest_line_all(spark, sf_dir, shapes):
    p, boxes = shapes
    expected = {}
    for r in p:
        far = []
        for _, ax, ay, bx, by in boxes:
            t = max(0.0, min(1.0, ((r["x"] - ax) * (bx - ax) + (r["y"] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            far.append(((r["x"] - ax - t * (bx - ax)) ** 2 + (r["y"] - ay - t * (by - ay)) ** 2) ** 0.5)
        if min(far) <= 40:
            expected[r["id"]] = min(far)
    assert {r["id"]: r["distance"] for r in QUERIES["nearest_line"](spark, sf_dir).collect()} == pytest.approx(expected, abs=1e-6)
