"""Token counts by byte-pair merging with a heap over a linked list.

The count of a piece is its initial symbols minus the merges: the adjacent pair
of the lowest rank is popped again and again, the leftmost of equals first, and
its two symbols become one. No ids come out. The file read is one in the format
of the ``tokenizers`` library with byte-level BPE and a split pattern; results
equal that library's, special strings in a text counting as one token each.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.words import BLOCK_BYTES, blocks

#: Words and pieces whose counts a worker remembers; at that number it starts anew.
REMEMBERED = 200_000
#: White space of the split patterns; that of Python's classes has more characters.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = str.maketrans("\t\n\x0b\x0c\r", " " * 5)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in prints:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Counter:
    """Counts tokens of texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: pair of symbols (left << 32 | right) to rank << 32 | merged symbol
        self.ranks = {ids[a] << 32 | ids[b]: rank << 32 | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        signs = byte_symbols()
        self.inner = [ids.get(c, -1) for c in signs]
        self.last = [ids.get(c + self.suffix, -1) for c in signs]
        steps = spec["normalizer"]["normalizers"] if spec["normalizer"] and spec["normalizer"]["type"] == "Sequence" else [spec["normalizer"]] if spec["normalizer"] else []
        kinds = [s["type"] for s in steps]
        if not set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizer not supported: {kinds}")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        first = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"]["type"] == "Sequence" else {}
        if first.get("type") != "Split" or not first.get("invert"):
            raise ValueError("pre-tokenizer not supported")
        pattern = first["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]")
        self.pieces = regex.compile(pattern).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words: dict[str, int] = {"": 0}
        self.known: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece of the split pattern."""
        raw = piece.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n = count = len(symbols)
        if n == 1:
            return 1
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = ranks.get(symbols[i] << 32 | symbols[i + 1])
            if found is not None:
                heap.append((found >> 32, i))
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = ranks.get(symbols[i] << 32 | symbols[j])
            if found is None or found >> 32 != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = found & 0xFFFFFFFF, -1
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (right := ranks.get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, (right >> 32, i))
            if (h := before[i]) >= 0 and (left := ranks.get(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, (left >> 32, h))
        return count

    def part(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii() and self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        known, count = self.known, 0
        for piece in self.pieces(text):
            n = known.get(piece)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = self.merged(piece)
                if len(piece) <= 64:
                    known[piece] = n
            count += n
        return count

    def word(self, word: str) -> int:
        """Tokens of a text without ASCII white space, which no token spans."""
        if self.special is None or "<" not in word:
            return self.part(word)
        return sum(1 if i % 2 else self.part(x) for i, x in enumerate(self.special.split(word)) if x)

    def count(self, text: str) -> int:
        """Tokens of a text."""
        words = text.translate(_BLANKS).split(" ") if not text.isascii() else _ascii_words(text)
        have = self.words
        if len(have) >= REMEMBERED:
            have.clear()
            have[""] = 0
        total = 0
        for w in words:
            n = have.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= 64:
                    have[w] = n
            total += n
        return total


def _ascii_words(text: str) -> list[str]:
    # of ASCII characters, str.split takes 0x1C-0x1F as white space too
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.translate(_BLANKS).split(" ")
    return text.split()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter for a file, made once in each worker."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_tokens, over_limit (more than limit tokens).

    tokenizer is the path of the tokenizer's file, found on every executor. A null
    text is empty; an empty or blank text has 0 tokens. Keys may be null or
    repeated. An empty table gives an empty result; other columns are not read.
    Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            for a, b in blocks(batch["text"], BLOCK_BYTES):
                texts = batch["text"][a:b].fill_null("")
                tokens = np.fromiter((count(t) for t in texts.to_pylist()), np.int64, b - a)
                yield pa.RecordBatch.from_arrays([batch["key"][a:b], pa.array(tokens), batch["n_bytes"][a:b]], names=["key", "n_tokens", "n_bytes"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"key {kind}, n_tokens long, n_bytes long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
