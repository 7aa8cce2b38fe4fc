"""A Merkle manifest of a table by nested-interval labels.

Rows are leaves, ranked within their group by key. A node carries the interval of
leaf ranks that it covers: at level l these start at multiples of 3^l, so the
bucket of an interval at a level is its start divided by that power. Trees are
grown STRIDE levels at a time: one row, a block, holds the 243 nodes that share
their ancestor STRIDE levels up. Going down, a block meets its ancestor in the
bucket of that level, if the ancestor's interval contains its own; what a
parent's interval has beside a node's own are the siblings. The groups' roots are
the leaves of one more tree, whose root stands for the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.store import Scratch

FANOUT, STRIDE = 3, 5
BLOCK = FANOUT**STRIDE
#: More pieces of groups than these are joined by a shuffle rather than sent to all executors.
BROADCAST_PIECES = 50_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before:string,after:string>>"
_Node = tuple[int, int, str]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Digest of these values, one after another: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    up = 0
    while FANOUT**up < n:
        up += 1
    return up


def levels(nodes: list[_Node], up: int) -> list[list[_Node]]:
    """The nodes and the up levels above them; a node's digest is that of its children's digests."""
    out = [nodes]
    for _ in range(up):
        low = out[-1]
        runs = [low[i : i + FANOUT] for i in range(0, len(low), FANOUT)]
        out.append([(run[0][0], run[-1][1], digest("".join(d for _, _, d in run))) for run in runs])
    return out


def siblings(own: _Node, parent: _Node, nodes: list[_Node]) -> tuple[str, str]:
    """Digests of the nodes in the parent's interval without the own one: those before it and those after it."""
    inside = [x for x in nodes if parent[0] <= x[0] and x[1] <= parent[1]]
    return "".join(d for _, hi, d in inside if hi <= own[0]), "".join(d for lo, _, d in inside if lo >= own[1])


def paths(nodes: list[_Node], up: int) -> list[list[tuple[str, str]]]:
    """For each node its siblings at every level below the top of its block."""
    tree = levels(nodes, up)
    found = []
    for low, high in zip(tree, tree[1:]):
        found.append([siblings(own, high[i // FANOUT], low[i // FANOUT * FANOUT : i // FANOUT * FANOUT + FANOUT]) for i, own in enumerate(low)])
    return [[level[i // FANOUT**t] for t, level in enumerate(found)] for i in range(len(nodes))]


def fold(own: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its siblings lead to."""
    for before, after in path:
        own = digest(before + own + after)
    return own


def _lift(n: int, k: int) -> int:
    """How many levels the blocks of stride k have above their nodes, in a tree of n leaves."""
    return min(STRIDE, max(0, height(n) - STRIDE * k))


def _nodes(items: list[dict]) -> list[_Node]:
    return [(x["lo"], x["hi"], x["digest"]) for x in items]


def ranked(rows: DataFrame, scratch: Scratch, name: str, part: str, order: list[Column]) -> DataFrame:
    """rows with rank (from 0, in this order within their part) and n, the rows of the part.

    Rows are dealt and sorted by ranges, so a part of any size is spread over tasks;
    each task's rows of a part follow those of the tasks before it.
    """
    sorted_ = rows.repartitionByRange(part, *order).sortWithinPartitions(part, *order)
    placed = scratch.save(sorted_.withColumn("place", F.monotonically_increasing_id()), f"{name}-placed")
    piece = F.shiftright("place", 33)
    pieces = placed.groupBy(F.col(part).alias("_part"), piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_rows"), F.min("place").alias("_first"))
    whole = Window.partitionBy("_part")
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # of one part, no more pieces than tasks
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).withColumn("n", F.sum("_rows").over(whole))
    pieces = scratch.save(pieces, f"{name}-pieces")
    few = pieces.count() <= BROADCAST_PIECES
    met = placed.join(F.broadcast(pieces) if few else pieces, (F.col(part) == F.col("_part")) & (piece == F.col("_piece")))
    return met.withColumn("rank", F.col("_before") + F.col("place") - F.col("_first")).drop("place", "_part", "_piece", "_rows", "_first", "_before")


@dataclass
class Tree:
    """The trees of all parts. blocks[k]: part, n, lo, hi, digest (of the top) and items (lo, hi, digest and, at k = 0, what the leaves carry)."""

    blocks: list[DataFrame]
    scratch: Scratch
    name: str

    def tops(self, k: int) -> DataFrame:
        return self.blocks[k].where((F.col("lo") == 0) & (F.col("hi") == F.col("n")))

    def roots(self) -> DataFrame:
        """part and digest of each part's root."""
        out = None
        for k in range(len(self.blocks)):
            found = self.tops(k).select("part", "digest")
            out = found if out is None else out.unionByName(found)
        return out

    def nodes(self) -> DataFrame:
        """All nodes above the leaves: part, level, lo, hi, digest; a leaf is what its block holds as an item."""
        out = None
        for k, blocks in enumerate(self.blocks):

            def run(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    made = []
                    for part, n, items in zip(*(batch[c].to_pylist() for c in ("part", "n", "items"))):
                        for t, level in enumerate(levels(_nodes(items), _lift(n, k))[1:], 1):
                            made += [(part, STRIDE * k + t, *node) for node in level]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [()] * 5, _NODE_TYPES)], names=["part", "level", "lo", "hi", "digest"])

            found = blocks.select("part", "n", "items").mapInArrow(run, "part string, level int, lo long, hi long, digest string")
            out = found if out is None else out.unionByName(found)
        return out

    def with_paths(self, above: DataFrame) -> DataFrame:
        """blocks[0] with path, the siblings of every level above a block's top, and subroot.

        above: part, subroot and path of what is above a part's root. From the top each
        block hands its items their paths; the blocks below meet them in the bucket of
        the level above, by containment.
        """
        down = None
        for k in reversed(range(len(self.blocks))):
            met = self.tops(k).join(above, "part")
            if down is not None:
                known = down.select(F.col("part").alias("_part"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "subroot", "path")
                bucket = lambda lo, k=k: F.floor(F.col(lo) / F.lit(BLOCK ** (k + 1)))
                inside = (F.col("part") == F.col("_part")) & (bucket("lo") == bucket("_lo")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
                met = met.unionByName(self.blocks[k].where((F.col("lo") > 0) | (F.col("hi") < F.col("n"))).join(known, inside).drop("_part", "_lo", "_hi"))
            if k == 0:
                return met
            down = self.scratch.save(met.select("part", "n", "items", "subroot", "path").mapInArrow(_hand_down(k), f"part string, lo long, hi long, subroot string, path {_PATH}"), f"{self.name}-down{k}")
        raise ValueError("a tree has at least one stride")


_NODE_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
_ARROW_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _hand_down(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, n, items, subroot, path in zip(*(batch[c].to_pylist() for c in ("part", "n", "items", "subroot", "path"))):
                own = paths(_nodes(items), _lift(n, k))
                out += [{"part": part, "lo": x["lo"], "hi": x["hi"], "subroot": subroot, "path": [{"before": b, "after": a} for b, a in p] + path} for x, p in zip(items, own)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("subroot", pa.string()), ("path", _ARROW_PATH)]))

    return run


def _top(k: int):
    """Add a block's digest: that of its one node STRIDE levels up, or as high as the tree goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [levels(_nodes(items), _lift(n, k))[-1][0][2] for n, items in zip(batch["n"].to_pylist(), batch["items"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], names=[*batch.schema.names, "digest"])

    return run


def grow(leaves: DataFrame, scratch: Scratch, name: str, most: int, carried: tuple[str, ...] = ()) -> Tree:
    """The trees over leaves: part, rank, n, digest and the carried columns. most: the rows of the largest part."""
    rows = leaves.select("part", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *carried)
    blocks, k = [], 0
    while True:
        bucket = F.floor(F.col("lo") / F.lit(BLOCK ** (k + 1))).alias("bucket")
        item = F.struct("lo", "hi", "digest", *(carried if k == 0 else ()))
        made = rows.groupBy("part", bucket).agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(item)).alias("items")).drop("bucket")  # BLOCK items at most
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields)
        blocks.append(scratch.save(made.mapInArrow(_top(k), f"{kinds}, digest string"), f"{name}-blocks{k}"))
        k += 1
        if BLOCK**k >= most:
            return Tree(blocks, scratch, name)
        rows = blocks[-1].where(F.col("n") > BLOCK**k).select("part", "n", "lo", "hi", "digest")


@dataclass
class Manifest:
    """trees: of the rows by group; over: the tree of the groups' roots; root: its root, null for an empty table."""

    trees: Tree | None
    over: Tree | None
    root: str | None


def build(docs: DataFrame, scratch: Scratch, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, claim: Column | None = None) -> Manifest:
    """The manifest of docs: leaves are digests of these columns, by group and ascending key.

    Groups are in the bytewise order of their text, a null group first. Null keys come
    first in their group; rows of one key are in the order of their digests, so
    repeated rows are leaves that may change places. Null, empty and very long
    values are digested whole. claim is a digest that a row comes with, to be
    checked against the manifest (its own, if none is given). Other columns are not
    read, and no name of a column of docs matters but those given.
    """
    part = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    own = leaf(*(F.col(c) for c in columns))
    rows = docs.select(part.alias("part"), F.col(key).alias("key"), own.alias("digest"), (own if claim is None else claim).alias("claim"))
    rows = ranked(scratch.save(rows, "digests"), scratch, "leaves", "part", [F.col("key").asc_nulls_first(), F.col("digest")])
    most = rows.agg(F.max("n")).first()[0]
    if most is None:
        return Manifest(None, None, None)
    trees = grow(rows, scratch, "trees", most, ("key", "claim"))
    scratch.drop("digests", "leaves-placed", "leaves-pieces")
    roots = trees.roots().select(F.lit("").alias("all"), F.col("part").alias("group"), "digest")
    roots = ranked(roots, scratch, "roots", "all", [F.col("group")]).withColumnRenamed("all", "part")
    over = grow(roots, scratch, "over", roots.agg(F.max("n")).first()[0], ("group",))
    return Manifest(trees, over, over.roots().first()["digest"])  # one row


def prove(made: Manifest, scratch: Scratch) -> DataFrame:
    """One row per leaf: part, key, rank, leaf, claim, subroot and path, the siblings of every level up to the root.

    A path is an array, from the leaf's level up, of the digests before and after the
    own one, each a text of joined hex digests.
    """
    nothing = made.trees.blocks[0].sparkSession.createDataFrame([("", None, [])], f"part string, subroot string, path {_PATH}")
    roots = made.over.with_paths(nothing).select("part", "n", "items", "path")
    arrow = pa.schema([("part", pa.string()), ("subroot", pa.string()), ("path", _ARROW_PATH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, items, path in zip(*(batch[c].to_pylist() for c in ("n", "items", "path"))):
                own = paths(_nodes(items), _lift(n, 0))
                out += [{"part": x["group"], "subroot": x["digest"], "path": [{"before": b, "after": a} for b, a in p] + path} for x, p in zip(items, own)]
            yield pa.RecordBatch.from_pylist(out, arrow)

    above = scratch.save(roots.mapInArrow(run, f"part string, subroot string, path {_PATH}"), "above")
    return made.trees.with_paths(above)


def verify(made: Manifest, scratch: Scratch) -> DataFrame:
    """One row per leaf: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    proof_sha256 is the digest of the leaf's siblings, level by level up to the root.
    folded_root is what the claimed digest and the siblings lead to; verified says
    that this is the root.
    """
    blocks, root = prove(made, scratch), made.root
    kind = next(f.dataType for f in blocks.schema["items"].dataType.elementType.fields if f.name == "key").simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["items"].flatten().field("key")
            out: list[tuple] = []
            for n, items, subroot, path in zip(*(batch[c].to_pylist() for c in ("n", "items", "subroot", "path"))):
                above = [(x["before"], x["after"]) for x in path]
                for x, p in zip(items, paths(_nodes(items), _lift(n, 0))):
                    p += above
                    folded = fold(x["claim"], p)
                    out.append((x["digest"], subroot, root, digest("".join(b + a for b, a in p)), folded, folded == root))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, [*[pa.string()] * 5, pa.bool_()])]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=["key", *_VERIFIED])

    return blocks.select("n", "items", "subroot", "path").mapInArrow(run, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


_VERIFIED = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(docs: DataFrame, scratch: Scratch, claimed: dict[str, Column] | None = None, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Build the manifest of docs and hold rows against it, as they would be with the claimed values in place of some columns.

    One row per row of docs: key, then as verify(). An empty table gives an empty result.
    """
    claimed = claimed or {}
    made = build(docs, scratch, key, group, columns, leaf(*(claimed.get(c, F.col(c)) for c in columns)))
    if made.trees is None:
        kind = docs.schema[key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{key}` {kind}, " + ", ".join(f"{c} {'boolean' if c == 'verified' else 'string'}" for c in _VERIFIED))
    return verify(made, scratch).withColumnRenamed("key", key)


def without_newlines(key: str = "doc_id", text: str = "text") -> Column:
    """The text, without its line feeds where the checksum of the decimal key is even; a null key changes nothing."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))
