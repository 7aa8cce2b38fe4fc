"""Removal of repeated passages by a compacted De Bruijn graph over words.

Nodes are sampled: of every window of ``window`` words the ``edge`` words in a row
with the least hash are its anchor, the same one wherever the window stands. The
anchors of a text, in order, are nodes; each two that follow one another are joined
by an edge, the words from the first one's start to the second one's end, and the
words before the first and behind the last node lead to the text's start and end.
A window can repeat only if its anchor occurs twice.

A node has one way in (or out) if all its occurrences have the same edge there. A
path goes on from a node with one way out to one with one way in. Joins bring these
degrees to the texts, which compact to paths: a path that is met twice repeats as a
whole, with its outer edges on sides that do not branch. Windows that lie in the path
of their anchor are known by that; windows around other repeated anchors are compared
one by one.

Hashes of 64 bits only draw the graph. What is removed is decided by digests of 128
bits of the words at the places where a path or window stands in its text: a path
whose places do not all have the same words is broken up into windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import words
from fathomline.llm.skew import join_counted
from fathomline.llm.store import Scratch

_U = np.uint64
WINDOW, EDGE = 35, 12
#: Order of anchors in a window: so many bits of the hash, then the place.
_PLACE_BITS = 28
_START, _END = _U(0x51), _U(0xE9)
#: Paths with equal hashes but other words that are put up with; 64 bits give none.
WRONG_PATHS = 10_000


class Graph:
    """Anchors and their edges in the texts of one block; bits: how much of each hash is used."""

    def __init__(self, texts: pa.Array, window: int, edge: int, bits: int = 64):
        self.words = w = words.cut(texts)
        self.window, self.edge = window, edge
        n = len(w.hash)
        self.starts = self.anchor_of = self.nodes = self.ins = self.outs = np.empty(0, np.int64)
        self.hash = np.empty(0, np.uint64)
        if n < window:
            return
        mers = w.windows(edge) >> _U(64 - bits)
        order = (words.mix(mers) >> _U(_PLACE_BITS)) << _U(_PLACE_BITS) | np.arange(len(mers), dtype=np.uint64)
        reach = window - edge + 1
        least, span = order, 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            rest = reach - span
            least = np.minimum(least[: len(least) - rest], least[rest:])
        last = np.repeat(w.first[1:], np.diff(w.first))  # of each word, the end of its text
        first = np.repeat(w.first[:-1], np.diff(w.first))
        self.starts = np.flatnonzero(last[: n - window + 1] >= np.arange(n - window + 1) + window)
        self.anchor_of = (least[self.starts] & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        flag = np.zeros(n, bool)
        flag[self.anchor_of] = True
        self.nodes = p = np.flatnonzero(flag)
        self.hash = mers[p]
        if not len(p):
            return
        new = np.r_[True, first[p[1:]] != first[p[:-1]]]  # whether a node is its text's first
        old = np.r_[new[1:], True]
        self.new = new
        self.low = np.where(new, first[p], np.r_[0, p[:-1]])  # where the edge into a node starts
        self.high = np.where(old, last[p], np.r_[p[1:], 0] + edge)  # and where that out of it ends
        self.ins = words.mix(w.spans(self.low, p + edge) ^ np.where(new, _START, _U(0))) >> _U(64 - bits)
        self.outs = words.mix(w.spans(p, self.high) ^ np.where(old, _END, _U(0))) >> _U(64 - bits)

    def owners(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.first, places, "right") - 1


class Plain:
    """The words of a block, each followed by one blank, and digests of runs of them."""

    def __init__(self, w: words.Words):
        size = w.end - w.start
        self.at = np.r_[0, np.cumsum(size + 1)]
        out = np.full(self.at[-1], 32, np.uint8)
        place = np.arange(size.sum())
        out[place + np.repeat(np.arange(len(size)), size)] = w.data[place + np.repeat(w.start - np.r_[0, np.cumsum(size)[:-1]], size)] if len(size) else 0
        self.raw = out.tobytes()

    def digest(self, low: int, high: int) -> bytes:
        return hashlib.blake2b(self.raw[self.at[low] : self.at[high]], digest_size=16).digest()

    def kept(self, low: int, gone: np.ndarray) -> str:
        """Digest of the words from low on that are not gone, joined by one space."""
        stay = np.diff(np.r_[0, (~gone).astype(np.int8), 0])
        first, last = self.at[low + np.flatnonzero(stay == 1)], self.at[low + np.flatnonzero(stay == -1)]
        return hashlib.sha256(b"".join(self.raw[a:b] for a, b in zip(first.tolist(), last.tolist()))[:-1]).hexdigest()


def _pairs(digests: list[bytes]) -> list[np.ndarray]:
    """Digests as two columns of integers."""
    table = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [table[:, 0], table[:, 1]]


def _covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words is in one of the spans from low to high (exclusive)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    return np.cumsum(step)[:n] > 0


def _nodes(window: int, edge: int, bits: int):
    """A row for each text and node in it: how often it is met, and the bits that all and that any of its ways in and out have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.blocks(batch["text"]):
                graph = Graph(batch["text"][a:b], window, edge, bits)
                if not len(graph.nodes):
                    continue
                owner, ways = graph.owners(graph.nodes), (graph.ins & _U(0xFFFFFFFF)) << _U(32) | graph.outs & _U(0xFFFFFFFF)
                order = np.lexsort((graph.hash, owner))
                owner, node, ways = owner[order], graph.hash[order].view(np.int64), ways[order]
                first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (node[1:] != node[:-1])])
                n = np.diff(np.r_[first, len(node)])
                every, any_ = np.bitwise_and.reduceat(ways, first).view(np.int64), np.bitwise_or.reduceat(ways, first).view(np.int64)
                columns = [batch["k"][a:b].take(pa.array(owner[first])), pa.array(node[first]), pa.array(n), pa.array(every), pa.array(any_, mask=every == any_)]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "node", "n", "every", "any"])

    return run


#: What is known of a node that is met more than once, and the columns of a settled text.
_TWICE, _ONE_IN, _ONE_OUT = 1, 2, 4
_SETTLED = "k long, n_words long, n_removed long, sha string, text string, low array<int>, high array<int>, at array<int>, which array<int>, d1 array<long>, d2 array<long>, times array<int>, paths array<struct<path:long,d1:long,d2:long>>"


def _settle(window: int, edge: int, bits: int, wrong: frozenset):
    """Texts with their paths taken out; text: only if windows are still to be compared, at: these, which: the place of each one's digest."""
    names = [c.split()[0] for c in _SETTLED.split(", ")]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = dict(zip(names[2:], [pa.int64(), pa.string(), pa.string(), ints, ints, ints, ints, longs, longs, ints, pa.list_(pa.struct([("path", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())]))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.blocks(batch["text"]):
                part = batch.slice(a, b - a)
                graph = Graph(part["text"], window, edge, bits)
                w, plain = graph.words, Plain(graph.words)
                same = w.windows(window)
                count = np.diff(w.first)
                window_of, node_of = np.searchsorted(graph.starts, w.first), np.searchsorted(graph.nodes, w.first)
                rows: dict[str, list] = {n: [] for n in kinds}
                for i in range(len(part)):
                    out = dict.fromkeys(kinds)
                    gone, flags, base = np.zeros(count[i], bool), part["flags"][i], int(w.first[i])
                    if flags.is_valid:
                        node, kind = np.asarray(flags.values.field("node")).view(np.uint64), np.asarray(flags.values.field("kind"))
                        order = np.argsort(node)
                        node, kind = node[order], kind[order]
                        own = np.arange(node_of[i], node_of[i + 1])
                        place = np.minimum(np.searchsorted(node, graph.hash[own]), len(node) - 1)
                        known = np.where(node[place] == graph.hash[own], kind[place], 0)
                        twice, one_in, one_out = (known & bit > 0 for bit in (_TWICE, _ONE_IN, _ONE_OUT))
                        on = twice[:-1] & twice[1:] & one_out[:-1] & one_in[1:]  # whether a path goes on to the next node
                        begin, end = np.flatnonzero(twice & ~np.r_[False, on]), np.flatnonzero(twice & ~np.r_[on, False])
                        low = np.where(one_in[begin], graph.low[own[begin]], graph.nodes[own[begin]])
                        high = np.where(one_out[end], graph.high[own[end]], graph.nodes[own[end]] + edge)
                        path = graph.hash[own[begin]].view(np.int64)
                        good = (high - low >= window) & ~np.isin(path, list(wrong))
                        places = [(p, plain.digest(x, y)) for p, x, y in zip(path[good].tolist(), low[good].tolist(), high[good].tolist())]
                        out["paths"] = [{"path": p, "d1": x, "d2": y} for (p, _), x, y in zip(places, *map(np.ndarray.tolist, _pairs([d for _, d in places])))]
                        starts = graph.starts[window_of[i] : window_of[i + 1]]
                        anchor = np.searchsorted(graph.nodes[own], graph.anchor_of[window_of[i] : window_of[i + 1]])
                        again = twice[anchor]
                        # the path of a window is that of its anchor, so that it is the same one wherever the window stands
                        number = np.maximum(np.cumsum(twice & ~np.r_[False, on]) - 1, 0)[anchor]
                        sure = again & good[number] & (low[number] <= starts) & (starts + window <= high[number]) if len(good) else again
                        asked, low, high = starts[again & ~sure], starts[sure], starts[sure] + window
                        if len(low):
                            cut = np.flatnonzero(np.diff(low) > 1)
                            low, high = low[np.r_[0, cut + 1]], high[np.r_[cut, len(high) - 1]]
                        gone = _covered(low - base, high - base, count[i])
                        if len(asked):
                            _, one, which, times = np.unique(same[asked], return_index=True, return_inverse=True, return_counts=True)
                            d1, d2 = _pairs([plain.digest(s, s + window) for s in asked[one].tolist()])
                            out |= {"low": low - base, "high": high - base, "at": asked - base, "which": which, "d1": d1, "d2": d2, "times": times, "text": part["text"][i].as_py()}
                    out["n_removed"] = int(gone.sum())
                    if out["text"] is None:
                        out["sha"] = plain.kept(base, gone)
                    for n, x in out.items():
                        rows[n].append(x)
                columns = [part["key"], part["k"], pa.array(count, pa.int64()), *(pa.array(rows[n], t) for n, t in kinds.items())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", *names])

    return run


def _finish(window: int):
    """Texts with the windows taken out whose digests are in ``again``, besides their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.blocks(batch["text"]):
                part = batch.slice(a, b - a)
                w = words.cut(part["text"])
                plain = Plain(w)
                removed, shas = [], []
                for i in range(len(part)):
                    low, high, at, which, d1, d2 = (np.asarray(part[c][i].values) for c in ("low", "high", "at", "which", "d1", "d2"))
                    if part["again"][i].is_valid:
                        met = part["again"][i].values
                        met = set(zip(met.field("d1").to_pylist(), met.field("d2").to_pylist()))
                        start = at[np.array([x in met for x in zip(d1.tolist(), d2.tolist())])[which]]
                        low, high = np.r_[low, start], np.r_[high, start + window]
                    gone = _covered(low, high, int(w.first[i + 1] - w.first[i]))
                    removed.append(int(gone.sum()))
                    shas.append(plain.kept(int(w.first[i]), gone))
                columns = [part["key"], part["n_words"], pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "n_removed", "sha"])

    return run


def remove_repeats(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", window: int = WINDOW, edge: int = EDGE, bits: int = 64) -> DataFrame:
    """One row per row of docs: key, n_words, n_removed, kept_sha256.

    A word is removed if a window of ``window`` words that covers it has the same
    words as one that starts anywhere else, in this text or another; windows are
    judged on the input. kept_sha256 is of the words left, joined by one space. Null
    and blank texts have no words; texts shorter than a window lose none. Repeated
    rows are texts like others, so a repeated text of a window or more is removed
    whole, the first one too. Keys may be null or repeated, as texts are told apart
    by their hash. An empty table gives an empty result; other columns are not read.
    edge (at most window) and bits (fewer make hashes collide, for tests) change the
    work, not the result.
    """
    if not 1 <= edge <= window:
        raise ValueError("edge must be from 1 to window")
    known = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    kind = docs.schema[key].dataType.simpleString()
    found = scratch.save(known.select("k", "text").mapInArrow(_nodes(window, edge, bits), "k long, node long, n long, every long, any long"), "nodes")
    degree = found.groupBy("node").agg(F.sum("n").alias("n"), F.bit_and("every").alias("every"), F.bit_or(F.coalesce("any", "every")).alias("any"), F.count(F.lit(1)).alias("_rows")).where("n > 1")
    branches = F.col("every").bitwiseXOR(F.col("any"))
    ways = F.when(F.shiftrightunsigned(branches, 32) == 0, _ONE_IN).otherwise(0) + F.when(F.shiftleft(branches, 32) == 0, _ONE_OUT).otherwise(0)
    degree = scratch.save(degree.select("node", (ways + _TWICE).cast("int").alias("kind"), "_rows"), "degrees")
    flags = join_counted(found.select("k", "node"), degree, ["node"], found.count()).groupBy("k")
    flags = flags.agg(F.collect_set(F.struct("node", "kind")).alias("flags"), F.count(F.lit(1)).alias("met"))
    # a text's copies each have all its nodes
    flags = scratch.save(flags.select("k", "flags", F.ceil(F.col("met") / F.size("flags")).alias("_rows")), "flags")
    scratch.drop("nodes", "degrees")
    met = join_counted(known, flags, ["k"], known.count(), "left").select("key", "k", "text", "flags")
    wrong: frozenset = frozenset()
    while True:
        settled = scratch.save(met.mapInArrow(_settle(window, edge, bits, wrong), f"key {kind}, {_SETTLED}"), f"settled{len(wrong)}")
        paths = settled.select(F.explode("paths").alias("p")).groupBy("p.path")
        paths = paths.agg(*(f(f"p.{d}").alias(f"{n}{d}") for d in ("d1", "d2") for n, f in (("low_", F.min), ("high_", F.max))), F.count(F.lit(1)).alias("n"))
        bad = paths.where("low_d1 <> high_d1 OR low_d2 <> high_d2 OR n < 2").select("path").limit(WRONG_PATHS + 1).collect()
        if not bad:
            break
        wrong |= {r["path"] for r in bad}
        if len(wrong) > WRONG_PATHS:
            raise ValueError("too many hashes collide")
    asked = settled.where("text IS NOT NULL").select("key", "k", "n_words", "text", "low", "high", "at", "which", "d1", "d2", "times")
    total = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("d1")), F.lit(0))).first()
    pairs = asked.select("k", F.explode(F.arrays_zip("d1", "d2", "times")).alias("x")).select("k", "x.*")
    twice = pairs.groupBy("d1", "d2").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("_rows")).where("n > 1").drop("n")
    again = join_counted(pairs.drop("times"), scratch.save(twice, "twice"), ["d1", "d2"], total[1]).groupBy("k")
    again = again.agg(F.collect_set(F.struct("d1", "d2")).alias("again"), F.count(F.lit(1)).alias("met"))
    again = scratch.save(again.select("k", "again", F.ceil(F.col("met") / F.size("again")).alias("_rows")), "again")
    rest = join_counted(asked, again, ["k"], total[0], "left").select("key", "n_words", "text", "low", "high", "at", "which", "d1", "d2", "again")
    rest = rest.mapInArrow(_finish(window), f"key {kind}, n_words long, n_removed long, sha string")
    out = settled.where("text IS NULL").select("key", "n_words", "n_removed", "sha").unionByName(rest)
    return out.select(F.col("key").alias(key), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))
