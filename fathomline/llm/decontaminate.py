"""Benchmark items in documents, by pigeonhole pieces and bit-parallel edit distance.

Texts are compared as sequences of words: runs of letters and digits, lower-cased.
An item of n words may differ from a passage by e = n * percent / 100 words
(substituted, inserted, deleted), a short one by none. Cut into e + 1 pieces, at
least one piece is whole in such a passage, so every passage has an exact piece
hit. The places around hits are merged where they overlap; in each Myers' algorithm
finds the least distance, a whole column of the dynamic programme in a few
operations on one integer.

Items go to the executors as texts, in blocks of BLOCK_ITEM_BYTES, each of which is
one pass over the documents; every worker makes its own index of the block, about
four times the size of the texts.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import words
from fathomline.llm.store import Scratch

_U = np.uint64
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_MARKS = re.compile(r"[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]")
#: Bytes of items that go to the executors at once; more are handled in further passes over the documents.
BLOCK_ITEM_BYTES = 16 << 20
#: Items of fewer words have to occur exactly, and of fewer than the second number do not make a document unclean.
MIN_WORDS, TELLING_WORDS = 8, 4
_FILTER_BITS = 22


def normal(text: str) -> str:
    """Lower case, with marks beyond ASCII blanked."""
    text = text.lower()
    return _MARKS.sub(" ", text) if not text.isascii() else text


def cut(texts: list[str]) -> words.Words:
    return words.cut(pa.array([normal(t) for t in texts], pa.large_string()), gap=_GAP)


def best_match(pattern: list[int], text: list[int], places: dict[int, int] | None = None) -> tuple[int, int]:
    """Least edit distance of pattern to any part of text, and where the first such part ends (exclusive).

    Myers 1999: vertical differences of the current column as two bit vectors.
    """
    m = len(pattern)
    if places is None:
        places = positions(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best, end = m, 0
    for j, symbol in enumerate(text):
        eq = places.get(symbol, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up = (minus | ~(across | plus)) & mask
        down = plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up <<= 1  # free start in the text: 0 comes in at the first row
        down <<= 1
        fresh = eq | minus
        plus = (down | ~(fresh | up)) & mask
        minus = up & fresh & mask
        if score < best:
            best, end = score, j + 1
    return best, end


def positions(pattern: list[int]) -> dict[int, int]:
    """For each symbol the bits of its positions in the pattern."""
    out: dict[int, int] = defaultdict(int)
    for i, symbol in enumerate(pattern):
        out[symbol] |= 1 << i
    return dict(out)


class Items:
    """Index of a block of items: for each length of piece the sorted hashes of the pieces, with their items and places."""

    def __init__(self, ids: list, texts: list[str], percent: int, min_words: int):
        cutted = cut(texts)
        some = np.flatnonzero(np.diff(cutted.first))
        self.ids = [ids[i] for i in some.tolist()]
        self.first = np.r_[cutted.first[some], len(cutted.hash)]  # items without words leave no gap
        self.hash, self.places = cutted.hash, lru_cache(4096)(self._places)
        self.size = np.diff(self.first)
        self.budget = np.where(self.size < min_words, 0, self.size * percent // 100)
        owner = np.repeat(np.arange(len(self.ids)), self.budget + 1)
        number = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(self.budget + 1)[:-1]], self.budget + 1) if len(owner) else owner
        low = number * self.size[owner] // (self.budget[owner] + 1)
        length = (number + 1) * self.size[owner] // (self.budget[owner] + 1) - low
        self.pieces = {}
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            h = cutted.windows(n)[self.first[owner[own]] + low[own]]
            own, h = own[np.argsort(h, kind="stable")], np.sort(h)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[h >> _U(64 - _FILTER_BITS)] = True
            self.pieces[n] = (h, owner[own], low[own], seen)

    def pattern(self, item: int) -> list[int]:
        return self.hash[self.first[item] : self.first[item + 1]].tolist()

    def _places(self, item: int) -> dict[int, int]:
        return positions(self.pattern(item))

    def ranges(self, w: words.Words) -> tuple[np.ndarray, ...]:
        """Text, item, first and last word (exclusive) of the places where an item has a piece and may be as a whole, merged where they overlap."""
        rows = []
        for n, (hashes, owner, low, seen) in self.pieces.items():
            h = w.windows(n)
            at = np.flatnonzero(seen[h >> _U(64 - _FILTER_BITS)])
            a, b = (np.searchsorted(hashes, h[at], side) for side in ("left", "right"))
            at, a, b = at[a < b], a[a < b], b[a < b]
            text = np.searchsorted(w.first, at, "right") - 1
            inside = at + n <= w.first[text + 1]
            at, a, b, text = at[inside], a[inside], b[inside], text[inside]
            which = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum()) if len(at) else at
            at, text, item = np.repeat(at, b - a), np.repeat(text, b - a), owner[which]
            start, e = at - low[which], self.budget[item]
            rows.append((text, item, np.maximum(start - e, w.first[text]), np.minimum(start + self.size[item] + e, w.first[text + 1])))
        text, item, start, stop = (np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 4
        order = np.lexsort((start, item, text))
        text, item, start, stop = text[order], item[order], start[order], stop[order]
        if not len(text):
            return text, item, start, stop
        pair = np.cumsum(np.r_[0, (text[1:] != text[:-1]) | (item[1:] != item[:-1])])
        far = len(w.hash) + 1  # keeps pairs apart in one running maximum
        reach = np.maximum.accumulate(stop + pair * far)
        new = np.flatnonzero(np.r_[True, (start + pair * far)[1:] > reach[:-1]])
        return text[new], item[new], start[new], (reach - pair * far)[np.r_[new[1:], len(text)] - 1]

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, word behind the last) of every item within its budget, the best place of each."""
        w = cut(texts)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, a, b in zip(*(x.tolist() for x in self.ranges(w))):
            best = found.get((text, item))
            if best and best[0] == 0:
                continue
            own = w.hash[a:b].tolist()
            pattern = self.pattern(item)
            distance, end = best_match(pattern, own, self.places(item))
            if distance <= self.budget[item] and (best is None or distance < best[0]):
                # the same match from its end: its start; it is no longer than the item and its budget
                back, length = best_match(pattern[::-1], own[max(0, end - len(pattern) - distance) : end][::-1])
                start = int(w.first[text])
                found[text, item] = (distance, a + end - length - start, a + end - start)
        return [(text, item, *rest) for (text, item), rest in sorted(found.items())]


_index: dict[str, Items] = {}


class Block:
    """The texts of one block of items, as they go to the executors; index() makes what a worker searches with, once."""

    def __init__(self, name: str, ids: list, texts: list[str], percent: int, min_words: int):
        self.name, self.made = name, (ids, texts, percent, min_words)

    def index(self) -> Items:
        if self.name not in _index:
            _index.clear()
            _index[self.name] = Items(*self.made)
        return _index[self.name]


def item_blocks(items: DataFrame, percent: int, min_words: int = MIN_WORDS, key: str = "item_id", text: str = "text", limit: int = BLOCK_ITEM_BYTES) -> Iterator[Block]:
    """The items, block by block; blocks are dealt by hash so that each has about limit bytes."""
    known = items.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = size // limit + 1
    for i in range(count):
        rows = known.where(F.pmod(F.xxhash64("key", "text"), F.lit(count)) == i).orderBy("key", "text").collect()  # about limit bytes
        yield Block(uuid.uuid4().hex, [r["key"] for r in rows], [r["text"] for r in rows], percent, min_words)


def contaminated(
    docs: DataFrame, items: DataFrame, percent: int = 20, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each document and item found in it: key, item key, distance, first_word, end_word, item_words.

    distance is in words and at most percent of the item's; items of fewer than
    min_words words are found where they occur exactly. first_word and end_word
    (exclusive) count the document's normalised words. Null items and items without
    words are in nothing, and null and empty texts hold nothing. Repeated rows are
    reported one by one. Empty tables give an empty result; other columns are not
    read. If both keys have one name, the item's is called item_ and that name. Documents are scanned once for each block of items, and nothing is shuffled.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = None
    for block in item_blocks(items, percent, min_words, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        part = rows.mapInArrow(_search(shared, item_kind), f"key {kind}, item {item_kind.simpleString()}, distance int, first_word int, end_word int, item_words int")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key if item_key != key else f"item_{key}"), "distance", "first_word", "end_word", "item_words")


def _search(shared, item_kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        index = shared.value.index()
        for batch in batches:
            for a, b in words.blocks(batch["text"]):
                found = index.find(batch["text"][a:b].to_pylist())
                which = pa.array([a + f[0] for f in found], pa.int64())
                columns = [batch["key"].take(which), pa.array([index.ids[f[1]] for f in found], to_arrow_type(item_kind))]
                columns += [pa.array([f[i] for f in found], pa.int32()) for i in (2, 3, 4)]
                columns.append(pa.array(index.size[[f[1] for f in found]].astype(np.int32)) if found else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "item", "distance", "first_word", "end_word", "item_words"])

    return run


def clean(
    docs: DataFrame, items: DataFrame, scratch: Scratch, percent: int = 20, min_words: int = MIN_WORDS, telling: int = TELLING_WORDS, text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """docs without the rows that hold an item of at least ``telling`` words, with all their columns.

    What holds an item is as in contaminated; shorter items are in too much prose to
    tell. Rows with a null text are kept, repeated rows are judged one by one, and
    empty tables change nothing. With several blocks of items the rows left are
    written between the passes, so that a task holds one index.
    """

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value.index()
            for batch in batches:
                for a, b in words.blocks(batch[text]):
                    whole = np.ones(b - a, bool)
                    whole[[f[0] for f in index.find(batch[text][a:b].fill_null("").to_pylist()) if index.size[f[1]] >= telling]] = False
                    yield batch.slice(a, b - a).filter(pa.array(whole))

        return run

    for i, block in enumerate(item_blocks(items, percent, min_words, item_key, item_text)):
        docs = scratch.save(docs, f"pass{i}") if i else docs
        docs = docs.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs
