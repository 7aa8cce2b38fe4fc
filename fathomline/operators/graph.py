"""Shortest paths over a table of edges, many origins at once.

Where labels need not go on in the order of their costs, origins are dealt into blocks,
and a row holds the labels of a node (and state) from all origins of a block as arrays:
a round joins the rows that changed with the edges that leave their nodes, shuffles
them by block and node and takes the least of each origin (see blocks()). Otherwise:

Labels (origin, node, cost, ...) spread by rounds: the labels that the last round
improved are joined with the edges that leave their nodes, the best new label of
each origin and node is kept, and those that beat the label held go on. A round
writes only labels that improved; once these outnumber the others all are merged,
so a label is written a number of times that grows with the logarithm of the
search. Nodes and origins are rows, so neither the graph nor a search has to fit a
task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fathomline.sources.store import Scratch


def expand(edges: DataFrame, oneway: str = "oneway") -> DataFrame:
    """Directed edges (u, v, ...): yes, true and 1 go forward only, -1 and reverse backward only, all else both ways."""
    kind = F.lower(F.coalesce(F.trim(F.col(oneway)), F.lit("")))
    forward, back = F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    ways = F.when(kind.isin("yes", "true", "1"), F.array(forward)).when(kind.isin("-1", "reverse"), F.array(back)).otherwise(F.array(forward, back))
    rest = [c for c in edges.columns if c not in ("u", "v", oneway)]
    return edges.select(*rest, F.explode(ways).alias("_e")).select("_e.u", "_e.v", *rest)


def allowed(edges: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Edges whose first access tag that is not empty does not close them."""
    names = tags or ["motor_vehicle", "motorcar", "vehicle", "access"]
    first = F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in names if c in edges.columns), F.lit(""))
    return edges.where(~F.lower(first).isin("no", "private", "restricted"))


def shortest(
    edges: DataFrame,
    origins: DataFrame,
    scratch: Scratch,
    rounds: int | None = None,
    cost: str = "w",
    step: Callable[[Column], Column] | None = None,
    second: str | None = None,
    state: tuple[Column, Column] | None = None,
    passes: Column | None = None,
    least: float | None = None,
    costs_only: bool = False,
    departs: Column | None = None,
    ahead: bool = False,
) -> DataFrame:
    """Labels (origin, node, state, cost, second, hops, prev, prev_state) of all that can be reached, or of what so many edges reach.

    Without rounds the search goes on until no label improves, so labels are least
    costs and those of prev fit them. With rounds a label may be followed by a
    better one of its prev, so that paths() is not for them.

    origins: (origin, node, start), start being the cost to begin with (a departure
    time, if costs are times). step makes a label's cost into that behind an edge
    (default: plus the edge's cost). second is a further quantity that is summed and
    breaks ties of cost, as do fewer edges and the lesser node before. Costs must not
    be negative.

    state: what a search has to remember of its way (a ferry it is on, rules half
    met), at the start and behind an edge; step, state and passes (whether an edge may
    be taken) may use the label's columns state and cost and those of the edge. Nodes
    are then labelled once for each state. least: the least that any edge costs. With
    it, labels go on in the order of their costs, as those within ``least`` of the
    lowest can't be improved any more; that is needed where a later arrival may find
    open what an earlier one finds closed. ahead: they go on at once all the same, and are
    found anew where one that they came from changes (see _ahead()); that takes about as
    many rounds as ways have edges, where the order of costs takes their cost over ``least``.
    Without least step and passes must not make a later arrival earlier. costs_only: labels are origin, node, state and cost alone; passes
    and states then do not use cost, and departs, instead of step, is the interval at whose
    multiples an edge can be entered (null: at any time), before its cost is added.
    """
    if costs_only and (rounds is not None or least is not None or step is not None) or departs is not None and not costs_only:
        raise ValueError("costs_only searches to the end and without step; departs is for it alone")
    if ahead and (least is None or least <= 0 or rounds is not None):
        raise ValueError("ahead is for searches to the end in which every edge costs something: least must be positive")
    if costs_only or rounds is None and least is None and step is None and state is None and passes is None and isinstance(edges.schema["u"].dataType, IntegralType):
        return blocks(edges, origins, scratch, cost, second, state, passes, departs, traced=not costs_only)
    key = ["origin", "node", "state"]
    begin, after_state = state or (F.lit(0), F.col("state"))
    none = F.lit(None).cast(edges.schema["u"].dataType)
    first = origins.select("origin", "node", begin.alias("state"), F.col("start").cast("double").alias("cost"), F.lit(0.0).alias("second"), F.lit(0).alias("hops"), none.alias("prev"))
    first = first.withColumn("prev_state", F.when(F.lit(False), F.col("state")))
    base, size = scratch.save_counted(first, "labels0")
    deltas: list[DataFrame] = []
    grown, front = 0, base
    extra = F.col(second).cast("double") if second else F.lit(0.0)
    ways = scratch.save(edges.select(F.col("u").alias("node"), F.col("v"), *(c for c in edges.columns if c not in ("u", "v"))), "ways")
    order = F.struct("cost", "second", "hops", "prev", "prev_state")
    best = lambda rows, name="new": rows.groupBy(*key).agg(F.min(order).alias(name))
    # a least path meets no node twice: who still improves after that many edges has negative costs
    nodes = ways.select("v").distinct().count() if rounds is None and state is None and least is None else None

    def expand(labels: DataFrame, on: str | list[str] = "node") -> DataFrame:
        met = labels.join(ways, on)
        if ahead:  # a label does not come from what came from it
            met = met.where(~(F.col("prev").eqNullSafe(F.col("v")) & F.col("prev_state").eqNullSafe(after_state)))
        met = met if passes is None else met.where(F.coalesce(passes, F.lit(False)))
        after = step(F.col("cost")) if step else F.col("cost") + F.col(cost)
        new = met.select(
            "origin", F.col("v").alias("node"), after_state.alias("state"), after.cast("double").alias("cost"), (F.col("second") + extra).alias("second"), (F.col("hops") + 1).alias("hops"), F.col("node").alias("prev"), F.col("state").alias("prev_state")
        )
        return new.where("cost IS NOT NULL")

    if ahead:
        return _ahead(base, ways, lambda labels: expand(labels, ["node", "v"]), best, key, scratch)
    # a round goes two edges where nothing stands against it, as rounds cost more than labels that come to nothing
    leap = rounds is None and least is None
    for turn in itertools.count(1) if rounds is None else range(1, rounds + 1):
        now, later = front, None
        if least is not None:
            low = front.groupBy("origin").agg(F.min("cost").alias("_low"))
            parted = front.join(low, "origin").withColumn("_now", F.col("cost") < F.col("_low") + least)
            now, later = parted.where("_now").drop("_low", "_now"), parted.where("NOT _now").drop("_low", "_now")
        new = expand(now)
        if leap:
            new = new.unionByName(expand(best(new).select(*key, "new.*")))
        held = best(reduce(DataFrame.unionByName, deltas, base), "old")
        better = best(new).join(held, key, "left").where(F.col("old").isNull() | (F.struct("new.cost", "new.second") < F.struct("old.cost", "old.second")))
        found, n = scratch.save_counted(better.select(*key, "new.*"), f"found{turn}")
        if n:
            deltas.append(found)
            grown += n
        if later is None:
            front = found
            if not n:
                break
        else:
            # of a label that waits and one that beats it only the better goes on
            front, waiting = scratch.save_counted(best(later.unionByName(found)).select(*key, "new.*"), f"front{turn}")
            if not waiting:
                break
        if nodes is not None and turn > nodes:
            raise ValueError(f"labels still improve after {turn} edges in a graph of {nodes} nodes: costs must not be negative")
        if grown > size:
            base, size = scratch.save_counted(best(reduce(DataFrame.unionByName, deltas, base)).select(*key, "new.*"), f"labels{turn}")
            deltas, grown = [], 0
    out = scratch.save(best(reduce(DataFrame.unionByName, deltas, base)).select(*key, "new.*"), "labels")
    scratch.drop_all_but("labels")
    return out


#: Labels of so many nodes are looked for by sending these to all executors, 16 bytes each; more by a shuffle.
BROADCAST_NODES = 200_000
#: Tables of changed labels that are read side by side.
MOST_TABLES = 24
#: The first round after which labels of more than half as many edges are given up; then at every doubling.
GIVEN_UP = 128


def _ahead(starts: DataFrame, ways: DataFrame, expand: Callable[[DataFrame], DataFrame], best: Callable[..., DataFrame], key: list[str], scratch: Scratch) -> DataFrame:
    """Labels of shortest() where a worse label can lead to an earlier arrival: all labels that may change are found anew from those before them.

    A round takes the nodes behind labels that changed, and finds all their labels anew from
    the present ones of the nodes before; one that nothing leads to any more is taken
    back. As edges cost something, right labels only depend on lesser ones: a round more
    and all below a further ``least`` are right, whatever the others are; without a change all are.

    Labels of nodes that can't be reached may keep each other up in a circle, at ever greater
    costs. Those of two nodes can't, as a label never comes from one that came from it.
    For longer circles those of more than half as many edges as there were rounds are
    given up after GIVEN_UP rounds and at every doubling; right ones among them are found again.
    """
    names = ["cost", "second", "hops", "prev", "prev_state"]
    order = F.struct(*names)
    at = ["origin", "node"]
    starts = scratch.save(best(starts).select(*key, "new.*"), "starts")
    base, size = scratch.save_counted(starts.withColumn("turn", F.lit(0)), "present0")
    held, grown, changed, own = ["present0"], 0, base, None
    pairs = scratch.save(ways.select("node", "v").distinct(), "pairs")
    before = pairs.select(F.col("node").alias("u"), F.col("v").alias("node"))
    labels = lambda: scratch.spark.read.schema(base.schema).parquet(*map(scratch.path, held))
    latest = lambda rows: rows.groupBy(*key).agg(F.max_by(order, "turn").alias("new")).select(*key, "new.*").where("cost IS NOT NULL")
    for turn in itertools.count(1):
        behind = changed.select(*at).distinct().join(pairs, "node").select("origin", F.col("v").alias("node"))
        hit, n = scratch.save_counted((behind if own is None else behind.unionByName(own.select(*at))).distinct(), f"hit{turn}")
        asked = hit.join(before, "node")
        wanted, many = scratch.save_counted(asked.select("origin", F.col("u").alias("node")).unionByName(hit).distinct(), f"wanted{turn}")
        near = scratch.save(latest(labels().join(F.broadcast(wanted) if many <= BROADCAST_NODES else wanted, at, "left_semi")), f"near{turn}")
        sent = near.join(asked.select("origin", F.col("u").alias("node"), F.col("node").alias("v")), at)
        new = best(expand(sent).unionByName(starts.join(hit, at, "left_semi")))
        old = near.join(hit, at, "left_semi").select(*key, order.alias("old"))
        found = new.join(old, key, "full").where(~F.col("new").eqNullSafe(F.col("old")))
        changed, n = scratch.save_counted(found.select(*key, "new.*", F.lit(2 * turn).alias("turn")), f"found{turn}")
        scratch.drop(f"hit{turn}", f"wanted{turn}", f"near{turn}")
        own = None
        if n:
            held.append(f"found{turn}")
            grown += n
        if n and turn >= GIVEN_UP and turn & (turn - 1) == 0:
            long = latest(labels()).where(F.col("hops") > turn // 2)
            none = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in names]
            own, m = scratch.save_counted(long.select(*key, *none, F.lit(2 * turn + 1).alias("turn")), f"given{turn}")
            held.append(f"given{turn}")
            grown += m
            changed = changed.unionByName(own)
        if not n:
            break
        if grown > size or len(held) > MOST_TABLES:
            _, size = scratch.save_counted(latest(labels()).withColumn("turn", F.lit(2 * turn + 1)), f"present{turn}")
            held, grown = [f"present{turn}"], 0
    out = scratch.save(latest(labels()), "labels")
    scratch.drop_all_but("labels")
    return out


#: Origins of a block, about: a row of labels has one entry for each.
BLOCK = 128
_NONE = -(2**63)


def _least(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of one block and key, in a row and the held one first, as one: of each origin the least by the arrays ``names`` in order.

    fresh says whether the result is not what was held. What an edge does to labels (gap, add,
    more, hop, via) is done here.
    """
    last = None  # the row of a key that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
        block, key = table["block"].to_numpy(), table["key"]
        new = np.r_[True, np.asarray(key[1:].to_numpy(zero_copy_only=False) != key[:-1].to_numpy(zero_copy_only=False)) | (np.diff(block) != 0)]
        cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = table.slice(low, high - low)
            starts = np.flatnonzero(new[low:high])
            group = np.cumsum(new[low:high]) - 1
            fresh = part["fresh"].to_numpy(zero_copy_only=False)
            matrix = lambda name: part[name].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            size = len(part["cost"][0])
            out, ahead = [], None
            for name in names:
                if name == "prev":  # edges have one node before for all origins
                    values = np.repeat(part["via"].fill_null(_NONE).to_numpy(zero_copy_only=False)[:, None], size, axis=1)
                    own = part["via"].is_null().to_numpy(zero_copy_only=False)
                    values[own] = matrix("prev")
                else:
                    values = matrix(name)
                    if name == "cost" and (gap := part["gap"].to_numpy()).any():
                        at = np.flatnonzero(gap)
                        values = values.copy()
                        values[at] = np.ceil(values[at] / gap[at, None]) * gap[at, None]
                    values = values + part[{"cost": "add", "second": "more", "hops": "hop"}[name]].to_numpy()[:, None]
                    if name == "cost":
                        far, first = np.isinf(values), values[starts]
                    elif name == "hops":
                        values = values.astype(np.int32)
                given = values[starts]
                if ahead is not None:
                    top = np.inf if values.dtype.kind == "f" else np.iinfo(values.dtype).max
                    values = np.where(ahead, top, values)
                found = np.minimum.reduceat(values, starts, axis=0)
                worse = values != found[group]
                ahead = worse if ahead is None else ahead | worse
                if name != "cost":
                    found[np.isinf(out[0][0])] = _NONE if name == "prev" else 0
                out.append((found, given))
            changed = fresh[starts] | np.any([(found != given).any(axis=1) for found, given in out], axis=0)
            n = len(starts)
            at = pa.array(starts)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * size)
            zero = lambda kind: pa.array(np.zeros(n), kind)
            columns = {"block": part["block"].take(at), "key": part["key"].take(at), "node": part["node"].take(at), "state": part["state"].take(at), "fresh": pa.array(changed)}
            columns |= {"gap": zero(pa.float64()), "add": zero(pa.float64()), "more": zero(pa.float64()), "hop": zero(pa.int32()), "via": pa.nulls(n, pa.int64())}
            columns |= {name: pa.ListArray.from_arrays(offsets, pa.array(found.ravel())) for name, (found, _) in zip(names, out)}
            made = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in batch.schema], schema=batch.schema)
            if high < len(block):
                yield made
            else:
                if n > 1:
                    yield made.slice(0, n - 1)
                last = made.slice(n - 1)
    if last is not None:
        yield last


def blocks(edges: DataFrame, origins: DataFrame, scratch: Scratch, cost: str, second: str | None, state: tuple[Column, Column] | None, passes: Column | None, departs: Column | None, traced: bool) -> DataFrame:
    """Labels of shortest(), with arrays of the costs from about BLOCK origins in a row. traced: with second, hops and prev, for nodes that are whole numbers."""
    begin, after_state = state or (F.lit(0), F.col("state"))
    names = ("cost", "second", "hops", "prev") if traced else ("cost",)
    none, never = F.lit(None).cast("bigint"), F.lit(float("inf"))
    identity = F.to_json(F.struct("node", "state")).alias("key")
    named = lambda df: df.withColumn("_o", F.to_json(F.struct("origin")))
    known = named(origins.select("origin").distinct())
    within = Window.partitionBy("block")
    known = known.withColumn("block", F.pmod(F.xxhash64("_o"), F.lit(max(1, -(-known.count() // BLOCK)))).cast("int"))
    known = scratch.save(known.withColumn("at", F.row_number().over(within.orderBy("_o")) - 1).withColumn("size", F.count(F.lit(1)).over(within)), "origins")
    ways = scratch.save(edges.select(F.col("u").alias("node"), F.col("v"), *(c for c in edges.columns if c not in ("u", "v"))), "ways")
    nodes = ways.select("v").distinct().count() if state is None else None
    rest = [F.lit(0.0).alias("gap"), F.lit(0.0).alias("add"), F.lit(0.0).alias("more"), F.lit(0).alias("hop"), none.alias("via")]
    every = F.sequence(F.lit(0), F.col("size").cast("int") - 1)
    like = lambda x: F.transform(every, lambda i: x)
    arrays = {"cost": F.transform(every, lambda i: F.when(i == F.col("at"), F.col("start").cast("double")).otherwise(never)), "second": like(F.lit(0.0)), "hops": like(F.lit(0)), "prev": like(F.lit(_NONE))}
    first = named(origins).drop("origin").join(known, "_o").withColumn("state", begin)
    rows = first.select("block", identity, "node", "state", F.lit(True).alias("fresh"), *rest, *(arrays[n].alias(n) for n in names))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for turn in itertools.count():
        sorted_ = rows.repartition("block", "key").sortWithinPartitions("block", "key", "fresh")
        labels = scratch.save(sorted_.mapInArrow(lambda batches: _least(batches, names), schema), f"labels{turn}")
        if turn:
            scratch.drop(f"labels{turn - 1}")
        changed = labels.where("fresh")
        if changed.isEmpty():
            break
        if nodes is not None and turn > nodes:
            raise ValueError(f"labels still improve after {turn} edges in a graph of {nodes} nodes: costs must not be negative")
        met = changed.join(ways, "node")
        met = met if passes is None else met.where(F.coalesce(passes, F.lit(False)))
        w = F.col(cost).cast("double")
        met = met.where(w.isNotNull())
        gap = F.lit(0.0) if departs is None else F.coalesce(departs.cast("double"), F.lit(0.0))
        extra = F.coalesce(F.col(second).cast("double"), F.lit(0.0)) if second else F.lit(0.0)
        via = F.col("node").cast("bigint") if traced else none
        edge = [gap.alias("gap"), w.alias("add"), extra.alias("more"), F.lit(1).alias("hop"), via.alias("via")]
        new = met.select("block", F.col("v").alias("node"), after_state.alias("state"), F.lit(True).alias("fresh"), *edge, *names[:-1] if traced else names, *([F.array().cast("array<bigint>").alias("prev")] if traced else []))
        rows = labels.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("key", identity))
    own = known.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "origin"))), lambda x: x["origin"]).alias("origin"))  # about BLOCK each
    listed = labels.select("block", "node", "state", *names).join(own, "block").select("node", "state", F.inline(F.arrays_zip("origin", *names))).where(F.col("cost") < never)
    if not traced:
        return listed.select("origin", "node", "state", "cost")
    kind = edges.schema["u"].dataType
    prev = F.nullif(F.col("prev"), F.lit(_NONE)).cast(kind)
    return listed.select("origin", "node", "state", "cost", "second", "hops", prev.alias("prev"), F.when(prev.isNotNull(), F.col("state")).alias("prev_state"))


def in_turns(before: Column, way: Column, node: Column, begins: Column) -> tuple[Column, Column]:
    """What rules over several ways make of turns: whether an edge may be taken, and the state (way, rules) behind it.

    A rule (only, steps) is a sequence of steps (node, way) from the way that it begins
    on; a node of null is any. rules are those begun, with the steps still to come.
    begins: rules that begin on the edge's way. A turn onto another way is the next
    step of some rules and ends the others. A rule's last step is forbidden, or, for
    an only rule, is the one turn allowed where it comes next: such rules decide,
    whatever is forbidden.
    """
    turns = before["way"].isNotNull() & (before["way"] != way)
    here = F.filter(before["rules"], lambda r: r["steps"][0]["node"].isNull() | (r["steps"][0]["node"] == node))
    due = F.filter(here, lambda r: F.size(r["steps"]) == 1)
    takes = lambda r: r["steps"][0]["way"] == way
    bound = F.filter(due, lambda r: r["only"])
    ok = F.when(F.size(bound) > 0, F.exists(bound, takes)).otherwise(~F.exists(due, lambda r: ~r["only"] & takes(r)))
    on = F.transform(F.filter(here, lambda r: takes(r) & (F.size(r["steps"]) > 1)), lambda r: F.struct(r["only"].alias("only"), F.slice(r["steps"], 2, F.size(r["steps"]) - 1).alias("steps")))
    rules = F.when(turns, F.array_sort(F.concat(on, begins))).when(before["way"].isNull(), begins).otherwise(before["rules"])
    return ~turns | ok, F.struct(way.alias("way"), rules.alias("rules"))


def transitions(edges: DataFrame, banned: DataFrame, only: DataFrame) -> DataFrame:
    """The graph of edges: (u, v, w), u and v being edge ids, v leaving where u ends, without turns that are not allowed.

    banned and only: (from_way, via, to_way). Where a way has only-rules at a node,
    these decide, whatever is banned. w is the length of v.
    """
    a = edges.select(F.col("id").alias("from_id"), F.col("way").alias("from_way"), F.col("v").alias("via"))
    b = edges.select(F.col("id").alias("to_id"), F.col("way").alias("to_way"), F.col("u").alias("via"), F.col("w"))
    met = a.join(b, "via")
    bound = only.select("from_way", "via").distinct().withColumn("_bound", F.lit(True))
    met = met.join(bound, ["from_way", "via"], "left")
    met = met.join(only.withColumn("_only", F.lit(True)).distinct(), ["from_way", "via", "to_way"], "left")
    met = met.join(banned.withColumn("_ban", F.lit(True)).distinct(), ["from_way", "via", "to_way"], "left")
    ok = F.when(F.col("_bound"), F.coalesce("_only", F.lit(False))).otherwise(~F.coalesce("_ban", F.lit(False)))
    return met.where(ok).select(F.col("from_id").alias("u"), F.col("to_id").alias("v"), "w")


def chains(rules: DataFrame, ways: DataFrame) -> DataFrame:
    """Check of rules over several ways: rule, status, via_node and junctions (the nodes where its ways meet, in order).

    rules: rule (each once) and members, an array of ways from the first to the last.
    ways: way and nodes, the nodes along it. unresolved: a way is not known or has no
    nodes, or there are fewer than two. unsupported: two ways in a row do not share
    exactly one end. Else ok; via_node is the last junction.
    """
    ends = ways.where(F.size("nodes") > 0).select("way", F.array_distinct(F.array(F.element_at("nodes", 1), F.element_at("nodes", -1))).alias("ends"))
    members = rules.select("rule", F.posexplode_outer("members").alias("place", "way"))
    placed = members.join(ends, "way", "left")
    known = placed.groupBy("rule").agg(F.count("place").alias("n"), F.count("ends").alias("found"))
    one = placed.select("rule", "place", F.explode("ends").alias("node"))
    # a way's end meets the next way's
    met = one.join(one.withColumn("place", F.col("place") - 1), ["rule", "place", "node"]).groupBy("rule", "place").agg(F.count(F.lit(1)).alias("shared"), F.min("node").alias("node"))
    steps = met.groupBy("rule").agg(F.count_if(F.col("shared") == 1).alias("good"), F.array_sort(F.collect_list(F.struct("place", "node"))).alias("at"))  # a rule's steps
    out = known.join(steps, "rule", "left")
    status = F.when((F.col("n") < 2) | (F.col("found") < F.col("n")), "unresolved").when(F.coalesce("good", F.lit(0)) < F.col("n") - 1, "unsupported").otherwise("ok")
    junctions = F.when(F.col("status") == "ok", F.transform("at", lambda x: x["node"]))
    return out.withColumn("status", status).select("rule", "status", F.element_at(junctions, -1).alias("via_node"), junctions.alias("junctions"))


def paths(labels: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """Node sequences (origin, node, state, path) of wanted labels, traced back a step a round for all of them together, to the last."""
    back = labels.select("origin", F.col("node").alias("at"), F.col("state").alias("at_state"), "prev", "prev_state")
    open_ = scratch.save(wanted.select("origin", "node", "state").withColumn("at", F.col("node")).withColumn("at_state", F.col("state")).withColumn("path", F.array("node")), "trace0")
    done = None
    for turn in itertools.count(1):
        met = open_.join(back, ["origin", "at", "at_state"])
        met = scratch.save(met, f"met{turn}")
        ended = met.where("prev IS NULL").select("origin", "node", "state", "path")
        done = ended if done is None else done.unionByName(ended)
        open_ = met.where("prev IS NOT NULL").select("origin", "node", "state", F.col("prev").alias("at"), F.col("prev_state").alias("at_state"), F.concat(F.array("prev"), "path").alias("path"))
        if open_.isEmpty():
            break
    return done


def along(labels: DataFrame, scratch: Scratch, carried: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """labels of a search to the end (origin, node, hops, prev, more columns, no states) with path, the nodes of their way, and carried columns.

    carried: by name the value at a start and that behind an edge, from the value before
    (the same name) and the label's columns. Each label is joined once, with the label
    before it, those of fewer edges first; so no way is walked again for what lies behind it.
    """
    carried = {"path": (F.array("node"), F.concat("path", F.array("node")))} | (carried or {})
    longest = labels.agg(F.max("hops")).first()[0]
    done = [scratch.save(labels.where("prev IS NULL").select(*labels.columns, *(begin.alias(n) for n, (begin, _) in carried.items())), "along0")]
    for turn in range(1, (longest or 0) + 1):
        before = done[-1].select("origin", F.col("node").alias("prev"), *carried)
        met = labels.where(F.col("hops") == turn).join(before, ["origin", "prev"])
        done.append(scratch.save(met.select(*labels.columns, *(after.alias(n) for n, (_, after) in carried.items())), f"along{turn}"))
    return reduce(DataFrame.unionByName, done)


def snap(points: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The nearest node of each point (ties by node), at whatever distance."""
    from fathomline.operators.neighbours import k_nearest

    return k_nearest(points, nodes.select(F.col("node").alias("id"), "x", "y"), 1, scratch).select("id", F.col("id2").alias("node"), "d2")
