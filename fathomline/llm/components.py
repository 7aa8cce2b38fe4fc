"""Connected components of a table of links, by union-find and stars.

Each task first joins the links it holds by union-find and passes on one link
per node to its root. Large stars and small stars then alternate over the rest
until nothing changes; each step keeps at most as many links as before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.store import Scratch


#: Links that one task joins; more are dealt to further tasks, and stars then join what these found.
TASK_LINKS = 1_000_000


class UnionFind:
    """Disjoint sets of integers; the root of a set is its least member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for batch in batches:
        for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            sets.union(x, y)
    rows = [(x, sets.find(x)) for x in list(sets.parent)]
    pairs = np.array([r for r in rows if r[0] != r[1]], np.int64).reshape(-1, 2)
    for at in range(0, len(pairs), 100_000):
        part = pairs[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])


def _large(links: DataFrame) -> DataFrame:
    """Link every node's larger neighbours to its least neighbour or itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; links lead from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    met = links.join(least, "a")
    out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Table of (node, root) for every node that is not the least of its component; links: (a, b), without null."""
    pairs = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), f"{name}-links")
    tasks = pairs.count() // TASK_LINKS + 1
    now = scratch.save(pairs.repartition(tasks).mapInArrow(_local, "a long, b long"), f"{name}-forest")
    mark, turn = None, 0
    while tasks > 1:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        now = scratch.save(_small(_large(now)), f"{name}-star{turn}")
        turn += 1
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def relabel(df: DataFrame, found: DataFrame, node: str, name: str) -> DataFrame:
    """Add the root of a node as column name; a node without one is its own."""
    met = df.drop(name).join(found, F.col(node) == F.col("node"), "left")
    return met.withColumn(name, F.coalesce("root", node)).drop("node", "root")
