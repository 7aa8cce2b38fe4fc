"""Least costs of given pairs: both ends search at once and a pair stops when its fronts pass its best meeting.

Labels (side, node, cost, prev) spread from the origin along the edges (side 0) and from
the destination against them (side 1). A label is open until it has been spread; in a
round those of a pair's side within ``width`` of its least open cost spread. The best
meeting of a pair is the least sum of both sides' costs at a node. Every label
below the least open cost of its side is final, so once the least open costs of both
sides add up to the best meeting or more, no way can be shorter, and once a side has
nothing open it has found all it can reach. Labels that could only lead to longer ways
are left out, and none from half of the best meeting on spreads, as both sides need not go
farther. A search thus stays within two circles around its ends.

The labels of a pair lie packed in rows of CHUNK. A round joins the labels that spread with
the edges and shuffles the new ones to the packed rows of their pair, where numpy keeps
the least, finds the best meeting and, once the pair is over, its way. A pair's labels
have to fit a task, other pairs' and the graph do not.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fathomline.sources.store import Scratch

#: Pairs of a matrix and of a batch.
MATRIX_PAIRS, BATCH_PAIRS = 25, 5_000


#: Labels of a packed row.
CHUNK = 512
#: Kinds of rows between rounds: packed labels that a search goes on with, labels that spread, ways found, packed labels of pairs that are over.
_GOING, _SPREAD, _FOUND, _OVER = range(4)
_NONE = -(2**63)
_SCHEMA = "pair long, kind int, side int, node long, cost double, prev long, labels binary, path array<long>"


@dataclass
class Found:
    """costs: pair, origin, destination, cost, meeting node and path, null where there is no way; labels: pair, side, node, cost and prev of all that were kept, if asked for."""

    costs: DataFrame
    labels: DataFrame | None


@dataclass
class _Labels:
    """Columns of a pair's labels."""

    side: np.ndarray
    open: np.ndarray
    node: np.ndarray
    cost: np.ndarray
    prev: np.ndarray

    def at(self, rows: np.ndarray) -> _Labels:
        return _Labels(*(c[rows] for c in (self.side, self.open, self.node, self.cost, self.prev)))

    def packed(self) -> Iterator[bytes]:
        """Rows of CHUNK labels, byte by byte of the columns, so that equal high bytes stand together."""
        for low in range(0, len(self.side), CHUNK):
            part = self.at(slice(low, low + CHUNK))
            wide = [c.view(np.uint8).reshape(-1, 8).T for c in (part.node, part.cost, part.prev)]
            yield np.concatenate([part.side[None].astype(np.uint8), part.open[None].astype(np.uint8), *wide]).tobytes()

    @staticmethod
    def unpacked(row: bytes) -> _Labels:
        rows = np.frombuffer(row, np.uint8).reshape(26, -1)
        wide = lambda low, kind: np.ascontiguousarray(rows[low : low + 8].T).view(kind).ravel()
        return _Labels(rows[0].astype(np.int32), rows[1].astype(bool), wide(2, np.int64), wide(10, np.float64), wide(18, np.int64))

    @staticmethod
    def joined(parts: list[_Labels]) -> _Labels:
        return _Labels(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("side", "open", "node", "cost", "prev")))


def _of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Labels]]:
    """Each pair with its labels, packed and new; rows come sorted by pair."""
    pair, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        pairs, packed = batch["pair"].to_numpy(), batch["labels"].is_valid().to_numpy(zero_copy_only=False)
        column = lambda name, none=0: batch[name].fill_null(none).to_numpy(zero_copy_only=False)
        new = _Labels(column("side"), np.ones(len(pairs), bool), column("node"), column("cost"), column("prev", _NONE))
        cuts = np.r_[0, np.flatnonzero(np.diff(pairs)) + 1, len(pairs)]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if pair is not None and pairs[low] != pair:
                yield pair, _Labels.joined(parts)
                parts = []
            pair = int(pairs[low])
            rows = np.arange(low, high)
            parts += [_Labels.unpacked(batch["labels"][i].as_py()) for i in rows[packed[low:high]].tolist()]
            parts.append(new.at(rows[~packed[low:high]]))
    if pair is not None:
        yield pair, _Labels.joined(parts)


def _way(labels: _Labels, meeting: int) -> list[int]:
    """The nodes from the origin over the meeting to the destination; labels are sorted by side and node."""
    halves = []
    for side in (0, 1):
        own = labels.at(labels.side == side)
        half, node = [], meeting
        while node != _NONE:
            half.append(node)
            node = int(own.prev[np.searchsorted(own.node, node)])
        halves.append(half)
    return halves[0][::-1] + halves[1][1:]


def _turn(pair: int, labels: _Labels, width: float) -> tuple[_Labels, np.ndarray | None, tuple]:
    """The least labels of a pair; which of them spread, None if the pair is over; and the cost and node of the best meeting, None if there is none."""
    # of equal costs the label that has been spread is kept, so it is not spread again
    labels = labels.at(np.lexsort((labels.prev, labels.open, labels.cost, labels.node, labels.side)))
    first = np.r_[True, (np.diff(labels.node) != 0) | (np.diff(labels.side) != 0)]
    labels = labels.at(first)
    forth, back = labels.at(labels.side == 0), labels.at(labels.side == 1)
    low = [c.cost[c.open].min(initial=np.inf) for c in (forth, back)]
    both, i, j = np.intersect1d(forth.node, back.node, assume_unique=True, return_indices=True)
    best, meeting = np.inf, None
    if len(both):
        sums = forth.cost[i] + back.cost[j]
        best, meeting = float(sums.min()), int(both[sums.argmin()])
    if np.isinf(low).any() or low[0] + low[1] >= best:
        return labels, None, (best, meeting)
    own, opposite = np.where(labels.side == 0, low[0], low[1]), np.where(labels.side == 0, low[1], low[0])
    useful = ~labels.open | (labels.cost + opposite < best)
    spreads = labels.open & useful & (labels.cost <= own + width) & (2 * labels.cost < best)
    labels.open &= ~spreads
    kept = useful | (labels.node == (_NONE if meeting is None else meeting))
    return labels.at(kept), spreads[kept], (best, meeting)


def _round(batches: Iterator[pa.RecordBatch], width: float, keep: bool) -> Iterator[pa.RecordBatch]:
    """Rows between rounds (_SCHEMA) from packed rows and new labels, sorted by pair."""
    kinds = {"pair": pa.int64(), "kind": pa.int32(), "side": pa.int32(), "node": pa.int64(), "cost": pa.float64(), "prev": pa.int64(), "labels": pa.binary(), "path": pa.list_(pa.int64())}

    def rows(pair: list | np.ndarray, kind: int, **columns) -> pa.RecordBatch:
        columns |= {"pair": pair, "kind": np.full(len(pair), kind)}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(len(pair), t) for c, t in kinds.items()], names=list(kinds))

    for pair, labels in _of_pairs(batches):
        labels, spreads, (best, meeting) = _turn(pair, labels, width)
        if spreads is None:
            none = meeting is None
            yield rows([pair], _FOUND, cost=[None if none else best], node=[meeting], path=[None if none else _way(labels, meeting)])
        else:
            front = labels.at(spreads)
            yield rows(np.full(len(front.node), pair), _SPREAD, side=front.side, node=front.node, cost=front.cost)
        if spreads is not None or keep:
            packed = list(labels.packed())
            yield rows([pair] * len(packed), _OVER if spreads is None else _GOING, labels=packed)


def _listed(packed: DataFrame) -> DataFrame:
    """pair, side, node, cost and prev of packed labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, row in zip(batch["pair"].to_pylist(), batch["labels"].to_pylist()):
                x = _Labels.unpacked(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.node), pair)), pa.array(x.side), pa.array(x.node), pa.array(x.cost), pa.array(x.prev, mask=x.prev == _NONE)], names=["pair", "side", "node", "cost", "prev"])

    return packed.select("pair", "labels").mapInArrow(run, "pair long, side int, node long, cost double, prev long")


def search(edges: DataFrame, wanted: DataFrame, scratch: Scratch, width: float, most: int | None = BATCH_PAIRS, labels: bool = True) -> Found:
    """Least costs of the pairs (origin, destination) of wanted over edges (u, v, w), nodes whole numbers, w not negative.

    Repeated pairs are one; a pair with a null end has no way, and one of a node with
    itself costs nothing. More than ``most`` pairs are refused; None stands for any number.
    width should be a few edges' cost: wider takes fewer rounds, narrower makes fewer labels.
    labels: whether they are written for those who want to look at them.
    """
    if not isinstance(edges.schema["u"].dataType, IntegralType):
        raise TypeError("nodes must be whole numbers")
    distinct = wanted.select("origin", "destination").distinct()
    pairs, n = scratch.save_counted(distinct.withColumn("pair", F.xxhash64("origin", "destination")), "pairs")
    if most is not None and n > most:
        raise ValueError(f"{n} pairs; at most {most} are searched at once")
    ends = lambda node, next_, side: edges.select(F.lit(side).alias("side"), F.col(node).cast("long").alias("node"), F.col(next_).cast("long").alias("next"), F.col("w").cast("double").alias("w"))
    ways = scratch.save(ends("u", "v", 0).unionByName(ends("v", "u", 1)).where("next IS NOT NULL AND w IS NOT NULL"), "ways")
    none = F.lit(None).cast("long")
    first = pairs.where("origin IS NOT NULL AND destination IS NOT NULL").select("pair", F.posexplode(F.array(F.col("origin").cast("long"), F.col("destination").cast("long"))).alias("side", "node"))
    new = first.select("pair", "side", "node", F.lit(0.0).alias("cost"), none.alias("prev"), F.lit(None).cast("binary").alias("labels"))
    over: list[DataFrame] = []
    for turn in itertools.count():
        dealt = new.repartition("pair").sortWithinPartitions("pair")
        rows = scratch.save(dealt.mapInArrow(lambda batches: _round(batches, width, labels), _SCHEMA), f"round{turn}")
        over.append(scratch.save(rows.where(F.col("kind") >= _FOUND), f"over{turn}"))
        if turn:
            scratch.drop(f"round{turn - 1}")
        going = rows.where(F.col("kind") == _GOING)
        if going.isEmpty():
            break
        spread = rows.where(F.col("kind") == _SPREAD).select("pair", "side", "node", "cost").join(ways, ["side", "node"])
        spread = spread.select("pair", "side", F.col("next").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("node").alias("prev"), F.lit(None).cast("binary").alias("labels"))
        new = spread.unionByName(going.select("pair", "side", "node", "cost", "prev", "labels"))
    ended = reduce(DataFrame.unionByName, over)
    found = ended.where(F.col("kind") == _FOUND).select("pair", "cost", F.col("node").alias("meeting"), "path")
    return Found(pairs.join(found, "pair", "left"), _listed(ended.where(F.col("kind") == _OVER)) if labels else None)


def matrix(edges: DataFrame, origins: DataFrame, destinations: DataFrame, scratch: Scratch, width: float, most: int = MATRIX_PAIRS) -> Found:
    """Least costs from every origin (origin) to every destination (destination): at most ``most`` pairs."""
    a, b = origins.select("origin").distinct(), destinations.select("destination").distinct()
    n, m = a.count(), b.count()
    if n * m > most:
        raise ValueError(f"{n} x {m} pairs; a matrix has at most {most}")
    return search(edges, a.crossJoin(b), scratch, width, most)  # no more pairs than that


def routes(found: Found, scratch: Scratch | None = None) -> DataFrame:
    """The nodes of a least way of each pair that has one: pair, path."""
    return found.costs.where("cost IS NOT NULL").select("pair", "path")
