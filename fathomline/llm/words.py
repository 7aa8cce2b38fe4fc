"""Words of whole texts and their hashes, computed on Arrow buffers with numpy.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. These are all
ASCII, so UTF-8 texts are cut on bytes. A word's hash is a polynomial over its
bytes modulo 2^64 with random byte values, mixed; k words' hash is a polynomial
over the hashes of the words, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handled in blocks of about so many bytes; one longer text is a block.
BLOCK_BYTES = 1 << 19

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE_BYTE, _BASE_WORD = 0x9E6C63D0876A9A47, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = x + _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size > 8 * BLOCK_BYTES:
            return out
        have = _powers[base] = out
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@dataclass
class Words:
    """Words of the texts of one block, in order."""

    data: np.ndarray  # bytes
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # of each text, its first word; and the number of words
    hash: np.ndarray
    _totals: np.ndarray | None = None

    def totals(self) -> np.ndarray:
        if self._totals is None:
            self._totals = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(self.hash * powers(_BASE_WORD, len(self.hash)), out=self._totals[1:])
        return self._totals

    def windows(self, k: int) -> np.ndarray:
        """Hash of each k words in a row, by first word; those that cross texts mean nothing."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        total = self.totals()
        return mix((total[k:] - total[:-k]) * powers(_inverse(_BASE_WORD), n) + _U(k))

    def spans(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the words from low to high (exclusive), for each pair of these."""
        total = self.totals()
        return mix((total[high] - total[low]) * powers(_inverse(_BASE_WORD), len(self.hash) + 1)[low] + (high - low).astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """First and last row (exclusive) of blocks of whole texts of about limit bytes."""
    offsets, _ = buffers(texts)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


def cut(texts: pa.Array, lower: bool = False, gap: np.ndarray = _SPACE) -> Words:
    """The words of all texts of one block; gap: whether each byte stands between words."""
    offsets, raw = buffers(texts)
    at = offsets - offsets[0]
    data = raw[offsets[0] : offsets[-1]]
    if lower:
        data = _LOWER[data]
    word = ~gap[data]
    edge = np.zeros(len(data) + 1, np.int8)  # 1: a word starts, -1: it has ended
    edge[:-1] = word
    edge[1:] -= word
    starts, ends = edge == 1, edge == -1
    inner = at[1:-1]  # where one text meets the next, one word may end and another start
    joint = inner[(inner > 0) & (inner < len(data))]
    joint = joint[word[joint - 1] & word[joint]]
    starts[joint] = ends[joint] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE_BYTE, len(data)), out=total[1:])
    own = (total[end] - total[start]) * powers(_inverse(_BASE_BYTE), len(data) + 1)[start]
    return Words(data, start, end, np.searchsorted(start, at), mix(own + (end - start).astype(np.uint64)))
