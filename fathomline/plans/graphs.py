"""Paths over a graph of customers: each has two ways out, with a length from the account's cents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import limits, rules, stats
from fathomline.operators import graph, near, pairs
from fathomline.plans.registry import query, table
from fathomline.plans.spatial import POINTS, points
from fathomline.sources import files, sinks
from fathomline.sources.store import Scratch


def edges(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = c.agg(F.count(F.lit(1)).alias("n"))
    cents = F.abs(F.round(F.col("c_acctbal") * 100).cast("long"))
    out = F.explode(F.array(F.struct(F.lit(0).alias("i"), ((F.col("c_custkey") * 7 + 3) % F.col("n") + 1).alias("v")), F.struct(F.lit(1).alias("i"), ((F.col("c_custkey") * 13 + 5) % F.col("n") + 1).alias("v"))))
    rows = c.crossJoin(n).select(F.col("c_custkey").alias("u"), cents.alias("cents"), out.alias("o"))  # n is one row
    w = 1 + (F.col("cents") + 31 * F.col("o.i")) % 97
    return rows.select("u", "o.v", w.alias("w"), (F.col("cents") % 11).alias("way"), (F.col("u") * 2 + F.col("o.i")).alias("id"), F.col("cents"))


EDGES = """(SELECT u, v, 1 + (cents + 31 * i) % 97 AS w, cents % 11 AS way, u * 2 + i AS id, cents FROM (SELECT c_custkey AS u, i, CASE WHEN i = 0 THEN (c_custkey * 7 + 3) % n + 1 ELSE (c_custkey * 13 + 5) % n + 1 END AS v, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS cents
    FROM customer CROSS JOIN (SELECT count(*) AS n FROM customer) CROSS JOIN (VALUES (0), (1)) x(i)))"""
HOPS = 6
#: Costs by which a pair search goes on in a round: an edge costs 1 to 97.
WIDTH = 60.0


#: The searches from origins to all nodes make a row for each origin and node; so origins are an argument, every
#: hundredth customer by default.
ORIGIN_EVERY = 100


def _origins(spark, sf_dir, every: int = ORIGIN_EVERY) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_custkey") % every == 0).select(F.col("c_custkey").alias("origin"), F.col("c_custkey").alias("node"), F.lit(0.0).alias("start"))


def _paths_sql(where: str = "true") -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT u, v, w FROM {EDGES} WHERE {where}), p AS (SELECT c_custkey AS origin, c_custkey AS node, 0::DOUBLE AS cost, 0 AS hops FROM customer WHERE c_custkey % 100 = 0
    UNION ALL SELECT p.origin, e.v, p.cost + e.w, p.hops + 1 FROM p JOIN e ON e.u = p.node WHERE p.hops < {HOPS}) """


def _search_sql(ways: str, starts: str, after: str = "p.cost + e.w", state: str = "", begin: str = "", where: str = "true") -> str:
    """Least costs to the end: p has one row for each origin, node and further key columns (state), replaced as long as costs improve."""
    keys = ["origin", "node", *(c.split(" AS ")[1] for c in state.split(" | ") if c)]
    listed, extra = ", ".join(keys), "".join(f", {c}" for c in state.split(" | ") if c)
    same = " AND ".join(f"o.{k} IS NOT DISTINCT FROM n.{k}" for k in keys)
    return f"""WITH RECURSIVE e AS MATERIALIZED ({ways}), p({listed}, cost) USING KEY ({listed}) AS (SELECT origin, node{begin}, cost FROM ({starts})
    UNION SELECT {", ".join("n." + k for k in keys)}, n.cost FROM (SELECT {listed}, min(cost) AS cost FROM (SELECT p.origin, e.v AS node{extra}, {after} AS cost FROM p JOIN e ON e.u = p.node WHERE {where}) GROUP BY {listed}) n LEFT JOIN recurring.p o ON {same} WHERE o.cost IS NULL OR n.cost < o.cost) """


_STARTS = "SELECT c_custkey AS origin, c_custkey AS node, 0::DOUBLE AS cost FROM customer WHERE c_custkey % 100 = 0"


@query(_paths_sql() + "SELECT origin, node, min(cost) AS cost FROM p GROUP BY origin, node")
def shortest_path_hops(spark, sf_dir):
    return graph.shortest(edges(spark, sf_dir), _origins(spark, sf_dir), Scratch(spark, "paths"), rounds=HOPS).select("origin", "node", "cost")


_LIMIT = "(SELECT *, CASE cents % 5 WHEN 0 THEN '' WHEN 1 THEN '7.5 t' WHEN 2 THEN 'none' WHEN 3 THEN 'default' ELSE '20' END AS maxweight FROM " + EDGES + ")"


def _limited(spark, sf_dir) -> DataFrame:
    kind = F.col("cents") % 5
    text = F.when(kind == 0, "").when(kind == 1, "7.5 t").when(kind == 2, "none").when(kind == 3, "default").otherwise("20")
    return edges(spark, sf_dir).withColumn("maxweight", text)


@query(f"SELECT id, CASE WHEN maxweight = '' THEN 'not_provided' WHEN maxweight = 'none' THEN 'unlimited' WHEN maxweight = 'default' THEN 'unsupported' ELSE 'supported' END AS status, CASE WHEN maxweight = '7.5 t' THEN 7.5::DOUBLE WHEN maxweight = '20' THEN 20.0::DOUBLE END AS value, maxweight IN ('', 'none', '20') AS passes FROM {_LIMIT}")
def constraint_filter(spark, sf_dir):
    """A 12-tonne vehicle; a limit that cannot be read closes the edge."""
    rows = _limited(spark, sf_dir).withColumn("x", limits.weight(F.col("maxweight")))
    return rows.select("id", "x.status", "x.value", limits.passes(F.col("x"), 12.0).alias("passes"))


@query(f"SELECT way, max(CASE WHEN maxweight = 'default' THEN 2 WHEN maxweight IN ('7.5 t', '20') THEN 1 ELSE 0 END) AS worst, count(*) AS edges, CAST(sum(w) AS BIGINT) AS length FROM {_LIMIT} GROUP BY way")
def status_profile(spark, sf_dir):
    status = limits.weight(F.col("maxweight"))["status"]
    rank = F.when(status == "unsupported", 2).when(status == "supported", 1).otherwise(0)
    return _limited(spark, sf_dir).withColumn("r", rank).groupBy("way").agg(F.max("r").alias("worst"), F.count(F.lit(1)).alias("edges"), F.sum("w").alias("length"))


@query(_search_sql(f"SELECT u, v, w FROM {EDGES} WHERE cents % 5 IN (0, 2, 4)", _STARTS) + "SELECT origin, node, cost FROM p")
def profile_paths(spark, sf_dir):
    """Paths of the vehicle that the limits let through; the filter reaches the edges before any search."""
    open_ = _limited(spark, sf_dir).where(limits.passes(limits.weight(F.col("maxweight")), 12.0))
    return near.costs(open_.select("u", "v", "w"), _origins(spark, sf_dir), Scratch(spark, "paths"))


@query(_search_sql(f"SELECT u, v, w FROM {EDGES}", _STARTS) + "SELECT a.origin, b.c_custkey AS node, p.cost FROM (SELECT DISTINCT origin FROM p) a CROSS JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 100 = 50) b LEFT JOIN p ON p.origin = a.origin AND p.node = b.c_custkey")
def od_matrix(spark, sf_dir):
    """Costs from each origin to each of the destinations; null where none is reached."""
    o = _origins(spark, sf_dir)
    d = table(spark, sf_dir, "customer").where("c_custkey % 100 = 50").select(F.col("c_custkey").alias("node"))
    return near.matrix(edges(spark, sf_dir).select("u", "v", "w"), o, d, Scratch(spark, "matrix"))


#: A batch: every twentieth customer and one that its key decides.
_BATCH = "(SELECT c_custkey AS origin, (c_custkey * 31 + 7) % n + 1 AS destination FROM customer CROSS JOIN (SELECT count(*) AS n FROM customer) WHERE c_custkey % 20 = 0)"


def _batch(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "customer").count()
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(key % 20 == 0).select(key.alias("origin"), ((key * 31 + 7) % n + 1).alias("destination"))


_BATCH_COSTS = _search_sql(f"SELECT u, v, w FROM {EDGES}", f"SELECT DISTINCT origin, origin AS node, 0::DOUBLE AS cost FROM {_BATCH}")


@query(_BATCH_COSTS + f"SELECT b.origin, b.destination, p.cost FROM {_BATCH} b LEFT JOIN p ON p.origin = b.origin AND p.node = b.destination")
def pair_costs(spark, sf_dir):
    """Least costs of a batch of pairs; a pair's search ends when its two fronts have passed its best meeting."""
    found = near.pair_search(edges(spark, sf_dir), _batch(spark, sf_dir), Scratch(spark, "pairs"), WIDTH)
    return found.costs.select("origin", "destination", "cost")


@query(_BATCH_COSTS + f"SELECT b.origin, b.destination, p.cost AS length FROM {_BATCH} b JOIN p ON p.origin = b.origin AND p.node = b.destination")
def pair_routes(spark, sf_dir):
    """The length of the way that is traced back for each pair: the shortest edges between its nodes, added up."""
    e = edges(spark, sf_dir)
    found = near.pair_search(e, _batch(spark, sf_dir), Scratch(spark, "pairs"), WIDTH)
    traced = pairs.routes(found).join(found.costs.select("pair", "origin", "destination"), "pair")
    whole = (F.get("path", F.lit(0)) == F.col("origin")) & (F.get("path", F.size("path") - 1) == F.col("destination"))
    steps = traced.where(whole).select("origin", "destination", "path", F.explode_outer(F.transform(F.slice("path", 2, F.size("path") - 1), lambda v, i: F.struct(F.get("path", i).alias("u"), v.alias("v")))).alias("s"))
    short = e.groupBy("u", "v").agg(F.min("w").alias("w"))
    met = steps.select("origin", "destination", "s.u", "s.v").join(short, ["u", "v"], "left")
    return met.groupBy("origin", "destination").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("double").alias("length"))


_BACK = """WITH RECURSIVE e AS MATERIALIZED (SELECT u, v, w FROM """ + EDGES + """), p(origin, node, k) USING KEY (origin, node) AS (SELECT c_custkey, c_custkey, {'cost': 0::DOUBLE, 'hops': 0, 'prev': NULL::BIGINT} FROM customer WHERE c_custkey % 100 = 0
    UNION SELECT n.origin, n.node, n.k FROM (SELECT p.origin, e.v AS node, min({'cost': p.k.cost + e.w, 'hops': p.k.hops + 1, 'prev': e.u::BIGINT}) AS k FROM p JOIN e ON e.u = p.node GROUP BY p.origin, e.v) n LEFT JOIN recurring.p o ON o.origin = n.origin AND o.node = n.node WHERE o.k IS NULL OR n.k < o.k),
    t AS (SELECT origin, node, node AS at, CAST(node AS VARCHAR) AS path FROM p UNION ALL SELECT t.origin, t.node, p.k.prev, p.k.prev || '>' || t.path FROM t JOIN p ON p.origin = t.origin AND p.node = t.at WHERE p.k.prev IS NOT NULL),
    r AS (SELECT t.origin, t.node, t.path, p.k.cost AS cost, p.k.hops AS hops FROM t JOIN p ON p.origin = t.origin AND p.node = t.node WHERE t.at = t.origin AND p.k.hops = len(string_split(t.path, '>')) - 1) """


def _routes(spark, sf_dir) -> DataFrame:
    labels = graph.shortest(edges(spark, sf_dir), _origins(spark, sf_dir), Scratch(spark, "route"))
    return graph.along(labels, Scratch(spark, "trace"))


@query(_BACK + "SELECT origin, node, path, cost, hops FROM r")
def route_segments(spark, sf_dir):
    """Paths as node sequences, with their cost."""
    least = edges(spark, sf_dir).groupBy("u", "v").agg(F.min("w").alias("w"))
    named = lambda g, cost, nodes, taken: {"node": g.name[nodes], "path": near.joined(g, nodes, taken, ">"), "cost": cost[nodes], "hops": np.full(len(nodes), taken.shape[1], np.int32)}
    found = near.routes(least, _origins(spark, sf_dir), Scratch(spark, "route"), named, "node long, path string, cost double, hops int")
    if found is not None:
        return found
    return _routes(spark, sf_dir).select("origin", "node", F.array_join("path", ">").alias("path"), "cost", "hops")


_RULES = "(SELECT u, v, way, w, cents % 3 = 0 AS ferry, CASE cents % 5 WHEN 0 THEN 'not_provided' WHEN 1 THEN 'supported' WHEN 2 THEN 'unlimited' WHEN 3 THEN 'unsupported' ELSE 'supported' END AS weight_status, CASE WHEN way IN (3, 5) THEN 'restricted' ELSE 'free' END AS turns, row_number() OVER (PARTITION BY u, v ORDER BY w, id) AS rn FROM " + EDGES + ")"
_PARTS = "s AS (SELECT origin, node, unnest(range(1, hops + 1)) AS seq, string_split(path, '>') AS n FROM r), g AS (SELECT s.origin, s.node, s.seq, x.u, x.v, x.way, x.w, x.ferry, x.weight_status, x.turns FROM s JOIN " + _RULES + " x ON x.rn = 1 AND x.u = CAST(n[seq] AS BIGINT) AND x.v = CAST(n[seq + 1] AS BIGINT)) "


def _rules(spark, sf_dir) -> DataFrame:
    """The edge that is taken from u to v and the rules behind it."""
    first = _limited(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("u", "v").orderBy("w", "id"))).where("rank = 1")
    status, turns = limits.weight(F.col("maxweight"))["status"], F.when(F.col("way").isin(3, 5), "restricted").otherwise("free")
    return first.select("u", "v", "way", "w", (F.col("cents") % 3 == 0).alias("ferry"), status.alias("weight_status"), turns.alias("turns"))


def _ruled_routes(spark, sf_dir, carried: dict) -> DataFrame:
    """All routes of an edge or more, with what is carried along their edges and the rules behind these."""
    scratch = Scratch(spark, "route")
    labels = graph.shortest(edges(spark, sf_dir), _origins(spark, sf_dir), scratch).select("origin", "node", "hops", "prev")
    last = _rules(spark, sf_dir).withColumnsRenamed({"u": "prev", "v": "node"})
    return graph.along(scratch.save(labels.join(last, ["prev", "node"], "left"), "ruled"), Scratch(spark, "trace"), carried).where("hops > 0")


def _segments(g: near.Graph, cost: np.ndarray, nodes: np.ndarray, taken: np.ndarray) -> dict | None:
    """Every edge of ways of as many edges, one way after the other."""
    many = taken.shape[1]
    if not many:
        return None
    e, more, tail = taken.ravel(), g.more, g.name[g.tail_of(taken)]
    word = lambda c: g.words[c].take(pa.array(more[c][e]))
    w = more["w"][taken].astype(np.int64)
    return {
        "node": np.repeat(g.name[nodes], many), "seq": np.tile(np.arange(1, many + 1, dtype=np.int32), len(nodes)), "u": tail.ravel(), "v": g.name[g.to[e]], "way": more["way"][e], "w": w.ravel(),
        "ferry": more["ferry"][e], "weight_status": word("weight_status"), "turns": word("turns"), "run": np.cumsum(w, axis=1).ravel(),
    }


def _records(g: near.Graph, cost: np.ndarray, nodes: np.ndarray, taken: np.ndarray) -> dict | None:
    """What route_response says of ways of as many edges."""
    if not taken.shape[1]:
        return None
    way, w, ferry = (g.more[c][taken] for c in ("way", "w", "ferry"))
    w, way = w.astype(np.int64), np.searchsorted(np.unique(g.more["way"]), way).astype(np.int32)

    def different(ways: np.ndarray) -> np.ndarray:  # -1 does not count
        ways = np.sort(ways, axis=1)
        return 1 + (np.diff(ways, axis=1) != 0).sum(axis=1) - (ways[:, 0] < 0)

    line = pc.binary_join_element_wise(pa.scalar('{"type":"LineString","nodes":['), near.joined(g, nodes, taken, ","), pa.scalar("]}"), "")
    return {
        "node": g.name[nodes], "segments": np.full(len(nodes), taken.shape[1]), "length": w.sum(axis=1), "ferry_length": np.where(ferry, w, 0).sum(axis=1), "ferry_segments": ferry.sum(axis=1),
        "ferry_ways": different(np.where(ferry, way, -1)), "ways": different(way), "unread_limits": g.more["unread"][taken].sum(axis=1), "line": line,
    }


@query(_BACK + ", " + _PARTS + "SELECT origin, node, seq, u, v, way, w, ferry, weight_status, turns, CAST(sum(w) OVER (PARTITION BY origin, node ORDER BY seq) AS BIGINT) AS run FROM g")
def rule_provenance(spark, sf_dir):
    """Every segment of every path with its way, the rules that apply to it, and the running length."""
    found = near.routes(_rules(spark, sf_dir), _origins(spark, sf_dir), Scratch(spark, "route"), _segments, "node long, seq int, u long, v long, way long, w long, ferry boolean, weight_status string, turns string, run long", rows=0)
    if found is not None:
        return found
    whole = F.coalesce(F.get("runs", F.size("runs") - 1), F.lit(0).cast("long")) + F.col("w")
    routes = _ruled_routes(spark, sf_dir, {"runs": (F.array().cast("array<bigint>"), F.concat("runs", F.array(whole)))})
    part = lambda i: F.struct(i.alias("seq"), F.get("path", i - 1).alias("u"), F.get("path", i).alias("v"), F.get("runs", i - 1).alias("run"))
    steps = routes.select("origin", "node", F.inline(F.transform(F.sequence(F.lit(1), F.col("hops")), part)))
    return steps.join(_rules(spark, sf_dir), ["u", "v"]).select("origin", "node", "seq", "u", "v", "way", "w", "ferry", "weight_status", "turns", "run")


@query(
    _BACK + ", " + _PARTS + """SELECT origin, node, count(*) AS segments, CAST(sum(w) AS BIGINT) AS length, CAST(coalesce(sum(w) FILTER (ferry), 0) AS BIGINT) AS ferry_length, count(*) FILTER (ferry) AS ferry_segments, count(DISTINCT way) FILTER (ferry) AS ferry_ways, count(DISTINCT way) AS ways,
    count(*) FILTER (weight_status = 'unsupported') AS unread_limits, '{"type":"LineString","nodes":[' || array_to_string(list(u ORDER BY seq), ',') || ',' || any_value(node) || ']}' AS line FROM g GROUP BY origin, node"""
)
def route_response(spark, sf_dir):
    """One record for each route: lengths, ferries, ways, limits that could not be read, and the line of its nodes."""
    ruled = _rules(spark, sf_dir).select("u", "v", "w", "way", "ferry", (F.col("weight_status") == "unsupported").alias("unread"))
    found = near.routes(ruled, _origins(spark, sf_dir), Scratch(spark, "route"), _records, "node long, segments long, length long, ferry_length long, ferry_segments long, ferry_ways long, ways long, unread_limits long, line string")
    if found is not None:
        return found
    zero, none, ferry = F.lit(0).cast("long"), F.array().cast("array<bigint>"), F.col("ferry")
    added = lambda name, by: (zero, F.col(name) + by)
    known = lambda name, way: (none, F.array_union(name, way))
    routes = _ruled_routes(spark, sf_dir, {
        "length": added("length", F.col("w")),
        "ferry_length": added("ferry_length", F.when(ferry, F.col("w")).otherwise(0)),
        "ferry_segments": added("ferry_segments", ferry.cast("long")),
        "unread_limits": added("unread_limits", (F.col("weight_status") == "unsupported").cast("long")),
        "ferry_ways": known("ferry_ways", F.when(ferry, F.array("way")).otherwise(none)),
        "ways": known("ways", F.array("way")),
    })
    line = F.concat(F.lit('{"type":"LineString","nodes":['), F.array_join(F.col("path").cast("array<string>"), ","), F.lit("]}"))
    sizes = [F.size(c).cast("long").alias(c) for c in ("ferry_ways", "ways")]
    return routes.select("origin", "node", F.col("hops").cast("long").alias("segments"), "length", "ferry_length", "ferry_segments", *sizes, "unread_limits", line.alias("line"))


@query(
    _search_sql(f"SELECT a.id AS u, b.id AS v, b.w FROM {EDGES} a JOIN {EDGES} b ON a.v = b.u WHERE CASE WHEN a.way = 3 THEN b.way = 4 ELSE NOT (a.way = 5 AND b.way IN (6, 7)) END", f"SELECT id AS origin, id AS node, w::DOUBLE AS cost FROM {EDGES} WHERE id % 150 = 0")
    + "SELECT origin, node, cost FROM p"
)
def restricted_turns(spark, sf_dir):
    """Search over edges, so that turns from way to way can be forbidden or made the only ones."""
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("u").alias("via")).distinct()
    make = lambda a, b: nodes.select(F.lit(a).cast("long").alias("from_way"), "via", F.lit(b).cast("long").alias("to_way"))
    turns = graph.transitions(e, make(5, 6).unionByName(make(5, 7)), make(3, 4))
    start = e.where("id % 150 = 0").select(F.col("id").alias("origin"), F.col("id").alias("node"), F.col("w").alias("start"))
    return near.costs(turns, start, Scratch(spark, "turns"))


# rules over chains of ways, anywhere: from way, then the ways to come; the last one forbidden or the only one
CHAINS = [(5, False, [6, 7]), (5, False, [6, 8]), (2, False, [9]), (3, True, [4, 1])]


@query(
    _search_sql(
        f"SELECT u, v, w, way FROM {EDGES}",
        _STARTS.replace("0::DOUBLE AS cost", "NULL::BIGINT AS way, 0 AS met, 0::DOUBLE AS cost"),
        state="e.way AS way | CASE WHEN p.way = e.way THEN p.met WHEN p.way = 5 AND e.way = 6 THEN 1 WHEN p.way = 3 AND e.way = 4 THEN 2 ELSE 0 END AS met",
        begin=", way, met",
        where="p.way IS NULL OR p.way = e.way OR CASE WHEN p.met = 2 THEN e.way = 1 ELSE NOT (p.met = 1 AND e.way IN (7, 8)) AND NOT (p.way = 2 AND e.way = 9) END",
    )
    + "SELECT origin, node, min(cost) AS cost FROM p GROUP BY origin, node"
)
def via_way_turns(spark, sf_dir):
    """Rules over several ways in a row, half-met ones being part of what a search remembers."""
    kind = "array<struct<only:boolean,steps:array<struct<node:bigint,way:bigint>>>>"
    none = F.array().cast(kind)
    rule = lambda only, ways: F.struct(F.lit(only).alias("only"), F.array(*(F.struct(F.lit(None).cast("long").alias("node"), F.lit(w).cast("long").alias("way")) for w in ways)).alias("steps"))
    begins = F.coalesce(*(F.when(F.col("way") == way, F.array(*(rule(only, to) for f, only, to in CHAINS if f == way))) for way in sorted({c[0] for c in CHAINS})), none)
    e = edges(spark, sf_dir).select("u", "v", "w", "way", begins.alias("begins"))
    ok, after = graph.in_turns(F.col("state"), F.col("way"), F.col("node"), F.col("begins"))
    start = F.struct(F.lit(None).cast("long").alias("way"), none.alias("rules"))
    return near.costs(e, _origins(spark, sf_dir), Scratch(spark, "chains"), state=(start, after), passes=ok)


@query(
    _search_sql(
        f"SELECT u, v, w, CASE WHEN cents % 3 = 0 THEN way ELSE -1 END AS ferry FROM {EDGES}",
        _STARTS.replace("0::DOUBLE AS cost", "-1::BIGINT AS ferry, 0::DOUBLE AS cost"),
        after="CASE WHEN e.ferry >= 0 AND e.ferry <> p.ferry THEN ceil(p.cost / 900) * 900 ELSE p.cost END + e.w",
        state="e.ferry AS ferry",
        begin=", ferry",
    )
    + "SELECT origin, node, min(cost) AS arrival FROM p GROUP BY origin, node"
)
def timed_paths(spark, sf_dir):
    """Earliest arrivals: edges of some ways are ferries that leave at full quarters of an hour; who boards one waits, who stays on the same one does not."""
    e = edges(spark, sf_dir).withColumn("ferry", F.when(F.col("cents") % 3 == 0, F.col("way")).otherwise(F.lit(-1)).cast("long"))
    boards = (F.col("ferry") >= 0) & (F.col("ferry") != F.col("state"))
    got = near.costs(e.select("u", "v", "w", "ferry"), _origins(spark, sf_dir), Scratch(spark, "timed"), departs=F.when(boards, 900), state=(F.lit(-1).cast("long"), F.col("ferry")))
    return got.withColumnRenamed("cost", "arrival")


def _ruled(spark, sf_dir) -> DataFrame:
    """Edges in seconds with rules that hold at some times; the second of each pair of ways is for one direction only, now and then."""
    c = F.col("cents")
    return edges(spark, sf_dir).select("u", "v", (300 + F.col("w")).alias("seconds"), (c % 4 == 0).alias("closes"), (c % 5 == 0).alias("slows"), (c % 7 == 0).alias("back"), (c % 6 == 0).alias("lorries"))


@query()
def conditional_paths(spark, sf_dir):
    """Earliest arrivals of a lorry where access, speed and direction depend on the time of arrival at an edge; tested against a plain search.

    Some edges are closed in the first third of each half hour, but to deliveries on
    edges that name them; some take twice as long in the second half of each hour;
    some can be taken against their direction in even hours only.
    """
    e = _ruled(spark, sf_dir).withColumn("against", F.lit(False))
    e = e.unionByName(e.where("back").select(F.col("v").alias("u"), F.col("u").alias("v"), "seconds", "closes", "slows", "back", "lorries", F.lit(True).alias("against")))
    t = F.col("cost")
    rule = lambda mode, kind, on: F.struct(F.lit(mode).alias("mode"), F.lit(kind).alias("class"), on.alias("active"))
    shut = F.col("closes") & (t % 1800 < 600)
    open_ = rules.access(F.array(rule("no", "hgv", shut & ~F.col("lorries")), rule("yes", "delivery", shut & F.col("lorries"))), ["hgv", "delivery"], F.lit(True))
    way = rules.oneway(F.lit("yes"), F.array(F.struct(F.lit("no").alias("value"), (F.floor(t / 3600) % 2 == 0).alias("active"))))
    passes = open_ & (~F.col("against") | (way == "no"))
    kmh = rules.speed(F.lit(80), F.array(F.struct(F.lit(40).alias("kmh"), (F.col("slows") & (t % 3600 >= 1800)).alias("active"))))
    # rules change at full ten minutes and come again after two hours
    kinds = ["closes", "slows", "lorries", "against"]
    kind = sum((F.col(c).cast("int") * 2**i for i, c in enumerate(kinds)), F.lit(0))
    every = spark.range(2 ** len(kinds)).select(F.col("id").alias("kind"), *((F.shiftright("id", i) % 2 == 1).alias(c) for i, c in enumerate(kinds)))
    speeds = every.crossJoin(spark.range(12).select(F.col("id").alias("slot"), (F.col("id") * 600.0).alias("cost"))).select("kind", "slot", F.when(passes, kmh).alias("speed"))  # sixteen kinds
    packed = e.select("u", "v", F.col("seconds").alias("w"), kind.alias("kind"))
    got = near.arrivals(packed, _origins(spark, sf_dir), Scratch(spark, "timed"), speeds, 600.0, 0, 12, lambda t, w, kmh: t + w * 80 / kmh, 300.0)
    if got is None:
        got = graph.shortest(e, _origins(spark, sf_dir), Scratch(spark, "rules"), step=lambda x: x + F.col("seconds") * 80 / kmh, passes=passes, least=300.0)
    return got.select("origin", "node", F.col("cost").alias("arrival"))


@query(f"SELECT count(*) AS edges, count(DISTINCT u) AS nodes, CAST(sum(w) AS BIGINT) AS length, max(w) AS longest, count(DISTINCT way) AS ways FROM {EDGES}")
def graph_summary(spark, sf_dir):
    return edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("u").alias("nodes"), F.sum("w").alias("length"), F.max("w").alias("longest"), F.countDistinct("way").alias("ways"))


@query(
    f"""SELECT u, v, way FROM {EDGES} WHERE cents % 4 = 0 UNION ALL SELECT v, u, way FROM {EDGES} WHERE cents % 4 = 1 UNION ALL SELECT u, v, way FROM {EDGES} WHERE cents % 4 > 1 UNION ALL SELECT v, u, way FROM {EDGES} WHERE cents % 4 > 1"""
)
def oneway_expansion(spark, sf_dir):
    kind = F.when(F.col("cents") % 4 == 0, "yes").when(F.col("cents") % 4 == 1, "-1").when(F.col("cents") % 4 == 2, "no")
    return graph.expand(edges(spark, sf_dir).select("u", "v", "way", kind.alias("oneway"))).select("u", "v", "way")


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS open FROM customer")
def access_filter(spark, sf_dir):
    kind = F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(kind == 1, "no").otherwise("").alias("motor_vehicle"), F.when(kind == 2, "Private").otherwise(F.when(kind == 3, "yes")).alias("vehicle"), F.when(kind == 3, "no").alias("access"))
    got = graph.allowed(rows).select("id", F.lit(True).alias("_open"))
    return rows.select("id").join(got, "id", "left").select("id", F.coalesce("_open", F.lit(False)).alias("open"))


@query(f"SELECT id, node, d2 FROM (SELECT a.id, b.id AS node, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) AS rn FROM {POINTS} a JOIN {POINTS} b ON a.label % 2 = 0 AND b.label % 2 = 1) WHERE rn = 1")
def snapped_nodes(spark, sf_dir):
    """Points to their nearest node."""
    p = points(spark, sf_dir)
    return graph.snap(p.where("label % 2 = 0").select("id", "x", "y"), p.where("label % 2 = 1").select(F.col("id").alias("node"), "x", "y"), Scratch(spark, "snap"))


PROFILES = {"car": None, "van": 7.0, "lorry": 12.0}


@query(
    _search_sql(
        "SELECT u, v, w, p.profile FROM " + _LIMIT + " CROSS JOIN (VALUES ('car'), ('van'), ('lorry')) p(profile) WHERE p.profile = 'car' OR maxweight IN ('', 'none', '20') OR p.profile = 'van' AND maxweight = '7.5 t'",
        _STARTS.replace("0::DOUBLE AS cost", "q.profile, 0::DOUBLE AS cost").replace("FROM customer", "FROM customer CROSS JOIN (VALUES ('car'), ('van'), ('lorry')) q(profile)"),
        state="p.profile AS profile",
        begin=", profile",
        where="e.profile = p.profile",
    )
    + "SELECT x.profile, x.origin, x.node, x.cost, x.cost - f.cost AS delta FROM p x JOIN p f ON f.profile = 'car' AND f.origin = x.origin AND f.node = x.node"
)
def profile_compare(spark, sf_dir):
    """Costs of several vehicles and their difference from the first, by one search: the profile is part of the node."""
    rows = _limited(spark, sf_dir).withColumn("limit", limits.weight(F.col("maxweight")))
    names, many = sorted(PROFILES), len(PROFILES)
    fits = F.filter(F.array(*(F.when(limits.passes(F.col("limit"), PROFILES[name]), F.lit(i)) for i, name in enumerate(names))), lambda x: x.isNotNull())
    key = lambda c: F.col(c).cast("long") * many + F.col("profile")
    ways = rows.withColumn("profile", F.explode(fits)).select(key("u").alias("u"), key("v").alias("v"), "w")
    starts = _origins(spark, sf_dir).withColumn("profile", F.explode(F.array(*map(F.lit, range(many))))).select("origin", key("node").alias("node"), "start")
    first = names.index(next(iter(PROFILES)))
    found = near.compared(ways, starts, Scratch(spark, "profiles"), names, first)
    if found is not None:
        return found
    # an origin's profiles are origins of their own, as a block is of one kind
    starts = starts.select(F.struct("origin", (F.col("node") % many).alias("profile")).alias("origin"), "node", "start")
    got = graph.shortest(ways, starts, Scratch(spark, "profiles"), costs_only=True)
    got = got.select(F.element_at(F.array(*map(F.lit, names)), (F.col("origin.profile") + 1).cast("int")).alias("profile"), F.col("origin.origin").alias("origin"), F.floor(F.col("node") / many).alias("node"), "cost")
    base = got.where(F.col("profile") == names[first]).select("origin", "node", F.col("cost").alias("base"))
    return got.join(base, ["origin", "node"]).select("profile", "origin", "node", "cost", (F.col("cost") - F.col("base")).alias("delta"))


@query(
    f"""WITH ends AS (SELECT way, u AS node FROM {EDGES} UNION SELECT way, v FROM {EDGES}), r AS (SELECT c_custkey AS id, c_nationkey % 11 AS from_way, (c_nationkey + 1) % 11 AS to_way, c_custkey AS via FROM customer)
    SELECT r.id, EXISTS (SELECT 1 FROM ends e WHERE e.way = r.from_way AND e.node = r.via) AS from_ok, EXISTS (SELECT 1 FROM ends e WHERE e.way = r.to_way AND e.node = r.via) AS to_ok FROM r"""
)
def restriction_checks(spark, sf_dir):
    """Turn relations whose via node is an end of both of their ways."""
    e = edges(spark, sf_dir)
    ends = e.select("way", F.col("u").alias("via")).unionByName(e.select("way", F.col("v").alias("via"))).distinct()
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 11).alias("from_way"), ((F.col("c_nationkey") + 1) % 11).alias("to_way"), F.col("c_custkey").alias("via"))
    side = lambda name, flag: ends.select(F.col("way").alias(name), "via", F.lit(True).alias(flag))
    met = r.join(side("from_way", "_f"), ["from_way", "via"], "left").join(side("to_way", "_t"), ["to_way", "via"], "left")
    return met.select("id", F.coalesce("_f", F.lit(False)).alias("from_ok"), F.coalesce("_t", F.lit(False)).alias("to_ok"))


# ways of customers from one of forty nodes by way of their own to another; rules of orders over two to four of them, some not there
_MEMBERS = "CASE o_orderkey % 3 WHEN 0 THEN [o_custkey, a] WHEN 1 THEN [o_custkey, a, b] ELSE [o_custkey, a, b, (b * 3 + 1) % 40 + o_orderkey % 7] END"
_CHAINED = f"(SELECT o_orderkey AS rule, {_MEMBERS} AS members FROM (SELECT *, (a * 3 + 1) % 40 + CASE WHEN o_orderkey % 11 = 0 THEN 90000000 ELSE 40 END AS b FROM (SELECT *, (o_custkey * 3 + 1) % 40 + 40 AS a FROM orders)))"


@query(
    f"""WITH e AS (SELECT c_custkey AS way, list_distinct([c_custkey % 40, (c_custkey * 3 + 1) % 40]) AS ends FROM customer), m AS (SELECT rule, unnest(members) AS way, generate_subscripts(members, 1) AS place FROM {_CHAINED}),
    p AS (SELECT m.rule, m.place, e.ends FROM m LEFT JOIN e USING (way)), s AS (SELECT a.rule, a.place, list_intersect(a.ends, b.ends) AS shared FROM p a JOIN p b ON b.rule = a.rule AND b.place = a.place + 1)
    SELECT k.rule, CASE WHEN missing THEN 'unresolved' WHEN wrong THEN 'unsupported' ELSE 'ok' END AS status, CASE WHEN NOT missing AND NOT wrong THEN last END AS via_node FROM (SELECT rule, bool_or(ends IS NULL) AS missing FROM p GROUP BY rule) k
    JOIN (SELECT rule, bool_or(coalesce(len(shared), 0) <> 1) AS wrong, arg_max(shared[1], place) AS last FROM s GROUP BY rule) USING (rule)"""
)
def chain_checks(spark, sf_dir):
    """Rules over several ways whose members are known and meet end to end, at one node a step."""
    key, o = F.col("c_custkey"), table(spark, sf_dir, "orders")
    ways = table(spark, sf_dir, "customer").select(key.alias("way"), F.array(key % 40, key + 100_000, (key * 3 + 1) % 40).alias("nodes"))
    o = o.withColumn("a", (F.col("o_custkey") * 3 + 1) % 40 + 40)
    o = o.withColumn("b", (F.col("a") * 3 + 1) % 40 + F.when(F.col("o_orderkey") % 11 == 0, 90_000_000).otherwise(40))
    last = (F.col("b") * 3 + 1) % 40 + F.col("o_orderkey") % 7
    kind = F.col("o_orderkey") % 3
    members = F.when(kind == 0, F.array("o_custkey", "a")).when(kind == 1, F.array("o_custkey", "a", "b")).otherwise(F.array(F.col("o_custkey"), F.col("a"), F.col("b"), last))
    return graph.chains(o.select(F.col("o_orderkey").alias("rule"), members.alias("members")), ways).select("rule", "status", "via_node")


@query(
    f"""SELECT id, CASE WHEN cents % 7 = 0 THEN false WHEN cents % 3 = 0 AND cents % 2 = 0 THEN false WHEN cents % 5 = 0 THEN cents % 2 = 0 ELSE true END AS open,
    least(CASE WHEN cents % 4 = 0 THEN NULL ELSE 80 END, CASE WHEN cents % 2 = 0 THEN 50 END, CASE WHEN cents % 3 = 0 THEN 30 END) AS kmh, CASE WHEN cents % 3 = 0 THEN 'no' WHEN cents % 2 = 0 THEN 'yes' ELSE 'base' END AS direction FROM {EDGES}"""
)
def conditional_rules(spark, sf_dir):
    """Access, speed and direction under conditions, for a lorry that delivers."""
    c = F.col("cents")
    even, third = c % 2 == 0, c % 3 == 0
    none = F.lit(None).cast("boolean")
    access = F.array(
        F.struct(F.lit("no").alias("mode"), F.lit("hgv").alias("class"), (even & third).alias("active")),
        F.struct(F.lit("yes").alias("mode"), F.when(even, "delivery").otherwise("taxi").alias("class"), (c % 5 == 0).alias("active")),
        F.struct(F.lit("no").alias("mode"), F.lit("bus").alias("class"), F.when(c % 7 == 0, none).otherwise(F.lit(False)).alias("active")),
    )
    speeds = F.array(F.struct(F.lit(50).alias("kmh"), even.alias("active")), F.struct(F.lit(30).alias("kmh"), third.alias("active")))
    ways = F.array(F.struct(F.lit("yes").alias("value"), even.alias("active")), F.struct(F.lit("no").alias("value"), third.alias("active")))
    base = F.when(c % 4 != 0, 80)
    return edges(spark, sf_dir).select("id", rules.access(access, ["hgv", "delivery"], F.lit(True)).alias("open"), rules.speed(base, speeds).alias("kmh"), rules.oneway(F.lit("base"), ways).alias("direction"))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT u, v, w, cents % 13 + 1 AS seconds FROM {EDGES}), p(origin, node, k) USING KEY (origin, node) AS (SELECT c_custkey, c_custkey, {{'cost': 0::DOUBLE, 'second': 0::DOUBLE}} FROM customer WHERE c_custkey % 100 = 0
    UNION SELECT n.origin, n.node, n.k FROM (SELECT p.origin, e.v AS node, min({{'cost': p.k.cost + e.w, 'second': p.k.second + e.seconds}}) AS k FROM p JOIN e ON e.u = p.node GROUP BY p.origin, e.v) n LEFT JOIN recurring.p o ON o.origin = n.origin AND o.node = n.node WHERE o.k IS NULL OR n.k < o.k)
    SELECT origin, node, k.cost AS distance, k.second AS duration FROM p"""
)
def two_quantities(spark, sf_dir):
    """Shortest ways by distance, of equal ones the fastest, with both quantities."""
    e = edges(spark, sf_dir).select("u", "v", "w", (F.col("cents") % 13 + 1).alias("seconds"))
    got = near.two_quantities(e, _origins(spark, sf_dir), Scratch(spark, "two"), "seconds")
    return got.select("origin", "node", F.col("cost").alias("distance"), F.col("second").alias("duration"))


_SUMMARY_PAIRS = f"(SELECT b.origin, b.origin // 20 % 4 AS grp, (abs(b.origin - b.destination) + 1)::DOUBLE AS straight, p.cost FROM {_BATCH} b LEFT JOIN p ON p.origin = b.origin AND p.node = b.destination)"


@query(
    _search_sql(f"SELECT u, v, w FROM {EDGES} WHERE cents % 5 IN (0, 2, 4)", f"SELECT DISTINCT origin, origin AS node, 0::DOUBLE AS cost FROM {_BATCH}")
    + f"""SELECT grp, count(*) AS sample_n, count(cost) AS route_n, round(100.0 * count(cost) / count(*), 2) AS reachable_pct, list_sort(list(cost) FILTER (cost IS NOT NULL))[least(count(cost), CAST(floor(count(cost) * 0.5) AS BIGINT) + 1)] AS median,
    list_sort(list(cost) FILTER (cost IS NOT NULL))[least(count(cost), CAST(floor(count(cost) * 0.9) AS BIGINT) + 1)] AS p90, round(avg(cost / straight), 6) AS ratio FROM {_SUMMARY_PAIRS} GROUP BY grp"""
)
def routing_summary(spark, sf_dir):
    """How many of a vehicle's pairs are reached, and the median, ninetieth and mean detour of their costs, by group."""
    open_ = _limited(spark, sf_dir).where(limits.passes(limits.weight(F.col("maxweight")), 12.0))
    found = near.pair_search(open_.select("u", "v", "w"), _batch(spark, sf_dir), Scratch(spark, "summary"), WIDTH)
    rows = found.costs.withColumn("grp", F.floor(F.col("origin") / 20) % 4).withColumn("straight", (F.abs(F.col("origin") - F.col("destination")) + 1).cast("double"))
    out = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("sample_n"), F.count("cost").alias("route_n"), F.round(F.lit(100.0) * F.count("cost") / F.count(F.lit(1)), 2).alias("reachable_pct"), F.round(F.avg(F.col("cost") / F.col("straight")), 6).alias("ratio"))
    return out.join(stats.quantiles(rows, ["grp"], "cost", 10.0, {"median": 0.5, "p90": 0.9}), "grp", "left")


@query(f"SELECT way, count(*) AS edges, CAST(sum(w) AS DOUBLE) AS length, count(*) FILTER (way % 3 = 0) AS ferries FROM {EDGES} GROUP BY way")
def graph_round_trip(spark, sf_dir):
    """The graph written as plain files of nodes and edges and read back, then counted by way."""
    scratch, e = Scratch(spark, "portable"), edges(spark, sf_dir)
    text = lambda c: F.col(c).cast("string").alias(c)
    ferry = F.when(F.col("way") % 3 == 0, "ferry").otherwise("")
    out = e.select(text("u"), text("v"), F.col("w").cast("double").alias("length_m"), F.lit("").alias("oneway"), F.lit("road").alias("highway"), F.col("way").cast("string").alias("way_id"), F.lit("").alias("name"), F.lit("").alias("ref"), ferry.alias("route"), F.lit("").alias("ferry"))
    nodes = e.select(F.col("u").alias("n")).unionByName(e.select(F.col("v").alias("n"))).distinct().select(F.col("n").cast("string").alias("node_id"), (F.col("n") / 1000.0).alias("lat"), (F.col("n") / 500.0).alias("lon"))
    sinks.write(out, scratch.path("edges"), "csv")
    sinks.write(nodes, scratch.path("nodes"), "csv")
    back = files.road_edges(spark, scratch.path("edges"), files.road_nodes(spark, scratch.path("nodes")))
    return back.groupBy(F.col("way_id").cast("long").alias("way")).agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("length"), F.count_if("is_ferry").alias("ferries"))
