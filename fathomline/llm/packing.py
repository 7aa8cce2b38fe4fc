"""Token ids in bit-packed files.

An id takes the bits that the vocabulary's largest id needs. A pack is one byte
string, readable by itself:

    "FBP1", width uint32, documents uint64, ids uint64, ids in a block uint32,
    blocks uint32, byte offset of each block from the payload's start (uint64),
    ids of each document (uint32), payload

Blocks are packed one by one and begin on a byte, so any block can be read by
itself. Bits are filled from the lowest up; integers are little-endian. On a
cluster packs are a binary column of Parquet files, which Spark can write to any
store; the bytes can be kept as a file of their own as well.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.store import Scratch
from fathomline.llm.words import BLOCK_BYTES, blocks

MAGIC, HEADER, BLOCK_IDS = b"FBP1", struct.Struct("<4sIQQII"), 4096
#: Ids after which a pack is closed, at the end of a document.
PACK_IDS = 1 << 21
#: Bytes of text in one part, which a task sorts and packs.
PART_BYTES = 128 << 20
#: Characters that end a word as a piece of their own.
_MARKS = ".,;:!?"
#: Such a mark behind a letter at the end of a word.
_LAST_MARK = re.compile("(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])([.,;:!?]) ")
#: Such a mark behind anything but a letter, digit or blank, with which it is one piece.
_AFTER_SIGN = re.compile("[^a-z0-9\u00df-\u00f6\u00f8-\u00ff ][.,;:!?] ")
#: Letters whose lower case is more than one letter or depends on its place.
_ODD = frozenset("\u0130\u03a3")
#: Words whose ids a worker remembers; at that number those met once are forgotten.
REMEMBERED = 400_000


def width(n_ids: int) -> int:
    """Bits for ids below n_ids."""
    return max(1, (n_ids - 1).bit_length())


def vocabulary(path: str) -> int:
    """Number of ids of a tokenizer's file, special tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    places = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(places.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_block(raw: bytes, count: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, "<u2", count).astype(np.uint32)
    places = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (places.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def pack(ids: np.ndarray, lengths: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    """A pack of documents whose ids stand in a row."""
    parts = [pack_block(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)])[:-1] if parts else np.empty(0)
    head = HEADER.pack(MAGIC, bits, len(lengths), len(ids), block, len(parts))
    return b"".join([head, offsets.astype("<u8").tobytes(), lengths.astype("<u4").tobytes(), *parts])


class Pack:
    """Reads a pack, whole or some ids of it."""

    def __init__(self, raw: bytes):
        magic, self.bits, documents, self.count, self.block, n = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a pack")
        at = HEADER.size
        self.offsets = np.frombuffer(raw, "<u8", n, at)
        self.lengths = np.frombuffer(raw, "<u4", documents, at + 8 * n)
        self.raw, self.at = raw, at + 8 * n + 4 * documents

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from start to end (exclusive), from the blocks that hold them."""
        end = self.count if end is None else min(end, self.count)
        if start >= end:
            return np.empty(0, np.uint32)
        first, last, out = start // self.block, (end - 1) // self.block, []
        for b in range(first, last + 1):
            low = self.at + int(self.offsets[b])
            high = self.at + int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else len(self.raw)
            out.append(unpack_block(self.raw[low:high], min(self.block, self.count - b * self.block), self.bits))
        return np.concatenate(out)[start - first * self.block : end - first * self.block]


class Encoder:
    """Encodes texts with the tokenizers library, word by word.

    Where white space is dropped and no token spans it, a text's ids are those of
    its words in a row; each word is then encoded once and remembered. New words are
    encoded together, parted by a mark. Of a vocabulary that is not like that whole
    texts are encoded.
    """

    mark = "\x01"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words are remembered here
        one, two, sign = (self._encode(x) for x in ("Ab", "cd,", self.mark))
        self.by_word = len(sign) == 1 and self._encode(f" Ab\n {self.mark} cd, ") == one + sign + two
        self.sign = sign[0] if sign else -1
        self.one_case = self._encode("Ab") == self._encode("ab")
        self.marks_apart = all(self._encode(f"ab{c} cd") == self._encode("ab") + self._encode(c) + self._encode("cd") for c in _MARKS)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        if suffix:
            self.is_end[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        self._start_anew()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _start_anew(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int64)
        self.seen = np.zeros(REMEMBERED, np.int32)

    def forget(self) -> None:
        """Forget the words that were met once, or all if there are too many others."""
        words, n = list(self.row), len(self.row)
        often = np.flatnonzero(self.seen[:n] > 1)
        start, size, flat = self.start[often], self.size[often], self.flat
        self._start_anew()
        if len(often) < REMEMBERED // 2:
            ends = np.cumsum(size)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
            self._add([words[i] for i in often.tolist()], flat[place], ends)

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Remember words whose ids stand in a row; ends: where those of each word end."""
        first, n = len(self.row), len(words)
        while first + n > len(self.start):
            self.start, self.size, self.seen = (np.append(x, np.zeros(len(x), x.dtype)) for x in (self.start, self.size, self.seen))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.empty(max(len(self.flat), len(ids)), np.uint32))
        self.flat[self.used : self.used + len(ids)] = ids
        size = np.diff(ends, prepend=0)
        self.start[first : first + n], self.size[first : first + n] = self.used + ends - size, size
        self.used += len(ids)
        self.row.update(zip(words, range(first, first + n)))

    def learn(self, words: list[str]) -> None:
        """Encode and remember words.

        A word of letters is one piece of the pre-tokenizer, with one token that
        ends it, in any case if the vocabulary has one case only; a mark behind it is
        one more piece. So pieces are encoded, many at once, and words made of them.
        """
        row = self.row
        one, two, other = [], [], []
        for w in words:
            if w.isalpha() and (w.isascii() or not _ODD.intersection(w)):
                one.append(w)
            elif w[:-1].isalpha() and w[-1] in _MARKS and (w.isascii() or not _ODD.intersection(w)):
                two.append(w)
            else:
                other.append(w)
        low = str.lower if self.one_case else str
        pieces = dict.fromkeys(chain(map(low, one), (low(w[:-1]) for w in two), (w[-1] for w in two)))
        other += self._learn_pieces([x for x in pieces if x not in row])
        other = [w for w in dict.fromkeys(other) if w not in row]  # a word's row is its place in the dictionary
        plain = [w for w in other if self.mark not in w]
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = self._fast(f" {self.mark} ".join(part) + f" {self.mark}")
            marks = np.flatnonzero(ids == self.sign)
            self._add(part, np.delete(ids, marks), marks - np.arange(len(marks)))
        for w in other:
            if self.mark in w:
                ids = self._fast(w)
                self._add([w], ids, np.array([len(ids)]))
        one = [w for w in one if w not in row]
        two = [w for w in two if w not in row]
        rows = np.fromiter((row[low(w)] for w in one), np.int64, len(one))
        self._add(one, *self._gather(rows))
        rows = np.fromiter((row[x] for w in two for x in (low(w[:-1]), w[-1])), np.int64, 2 * len(two))
        ids, ends = self._gather(rows)
        self._add(two, ids, ends[1::2])

    def _learn_pieces(self, pieces: list[str]) -> list[str]:
        """Encode pieces; returns those that did not turn out to be one piece each."""
        bad = []
        for at in range(0, len(pieces), 512):
            part = pieces[at : at + 512]
            ids = self._fast(" ".join(part))
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._add(part, ids, ends)
            else:
                bad += part
        return bad

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of remembered words in a row, and where those of each end."""
        size = self.size[rows]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[rows] - (ends - size), size)
        return self.flat[place], ends

    def _fast(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id if there is one, and how many each has."""
        if self.by_word:
            ids, ends = self._by_word(texts)
        else:
            made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids, ends = np.concatenate([np.empty(0, np.uint32), *made]), np.cumsum([len(x) for x in made], dtype=np.int64)
        lengths = np.diff(ends, prepend=0)
        if end is not None:
            ids = np.insert(ids, ends, end)
            lengths = lengths + 1
        return ids, lengths

    def _cut(self, text: str) -> str:
        """The text with blanks between what is remembered: words, or, of texts in Latin letters, lower-case words and the marks behind them."""
        text = _blanked(text)
        if self.one_case and self.marks_apart and "<|" not in text:
            try:
                text.encode("latin-1")  # letters of which each has one lower case
            except UnicodeEncodeError:
                return text
            text = text.lower()
            if _AFTER_SIGN.search(text):
                return _LAST_MARK.sub(r" \1 ", text)
            for c in _MARKS:
                text = text.replace(c + " ", f" {c} ")
        return text

    def _by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.row) >= REMEMBERED:
            self.forget()
        split = [self._cut(t).split(" ") for t in texts]
        words = list(chain.from_iterable(split))
        rows = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0).tolist()
        new = [words[i] for i in missing]
        self.learn(list(dict.fromkeys(new)))
        rows[missing] = np.fromiter(map(self.row.__getitem__, new), np.int64, len(new))
        self.seen[: len(self.row)] += np.bincount(rows, minlength=len(self.row)).astype(np.int32)
        ids, word_ends = self._gather(rows)
        total = np.concatenate([[0], word_ends])
        ends = total[np.cumsum([len(s) for s in split])] if split else np.empty(0, np.int64)
        if max(map(len, new), default=0) > 1 << 12:
            self._start_anew()  # no use in remembering such words
        return ids, ends


def _blanked(text: str) -> str:
    """The text with all ASCII white space as blanks."""
    for c in "\n\t\r\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder for a file, made once in each worker."""
    return Encoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, n_ids: int, end: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode docs and write packs under path, in ascending order of key; returns the table written.

    Rows of the table: part and pack number the packs in order; keys has the keys of
    the pack's documents; ids counts its ids; data is the pack. A null text is
    empty; null keys come first, and rows of one key stand in the order of their
    texts. An empty table gives no packs. The texts are shuffled once, by range of
    key; each task encodes and packs what it has sorted, a pack at a time.
    """
    kind = docs.schema[key].dataType.simpleString()
    bits = width(n_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        number, held, held_ids, keys, part = 0, [], 0, [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for x, _ in held])
            lengths = np.concatenate([n for _, n in held])
            own = pa.concat_arrays(keys)
            columns = [
                pa.array([part], pa.int32()),
                pa.array([number], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                pa.array([len(ids)], pa.int64()),
                pa.array([pack(ids, lengths, bits)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["part", "pack", "keys", "ids", "data"])

        for batch in batches:
            for a, b in blocks(batch["text"], BLOCK_BYTES):
                part = batch["part"][a].as_py()
                ids, lengths = coder.encode(batch["text"][a:b].fill_null("").to_pylist(), end)
                held.append((ids, lengths))
                keys.append(batch["key"][a:b])
                held_ids += len(ids)
                if held_ids >= PACK_IDS:
                    yield close()
                    number, held, held_ids, keys = number + 1, [], 0, []
        if held:
            yield close()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spark = docs.sparkSession
    # lengths of one column, to have parts of a bounded size whatever the table's
    weight = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), weight // PART_BYTES + 1)
    placed = rows.repartitionByRange(parts, "key", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    placed = placed.sortWithinPartitions("key", F.xxhash64("text"))
    packs = placed.mapInArrow(run, f"part int, pack int, keys array<{kind}>, ids long, data binary")
    packs.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(packs.schema).parquet(path)


def _starts(packs: DataFrame) -> DataFrame:
    """Of each pack (part, pack, ids) how many ids are before it: parts, then packs within a part, by sums over counts only."""
    inside = Window.partitionBy("part").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = packs.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("earlier"))
    starts = packs.select("part", "pack", "ids", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("here")).join(sums, "part")
    return starts.select("part", "pack", "ids", (F.col("earlier") + F.col("here")).alias("before"))


def read_spans(packs: DataFrame, spans: DataFrame) -> DataFrame:
    """The ids of spans (name, start, end; end exclusive, counted over all packs): name and array ids, from the blocks that hold them.

    Names are told apart, so each has one span. A span beyond the last id ends there,
    and an empty one has no ids; null bounds are empty. Only packs that a span meets
    are read, and of these only the blocks that it needs are unpacked.
    """
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / PACK_IDS), F.floor((high - 1) / PACK_IDS)))
    wanted = spans.where("start < end AND end > 0").select("name", F.greatest("start", F.lit(0)).alias("start"), "end")
    end = F.col("before") + F.col("ids")
    where = _starts(packs).where("ids > 0").withColumn("bin", bins(F.col("before"), end))
    met = wanted.withColumn("bin", bins(F.col("start"), F.col("end"))).join(where, "bin").where((F.col("start") < end) & (F.col("end") > F.col("before"))).drop("bin", "ids").distinct()
    kind = spans.schema["name"].dataType.simpleString()
    asked = met.groupBy("part", "pack").agg(F.collect_list(F.struct("name", (F.col("start") - F.col("before")).alias("low"), (F.col("end") - F.col("before")).alias("high"), F.greatest("start", "before").alias("at"))).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, spans_ = Pack(batch["data"][i].as_py()), batch["asked"][i].values
                found = [one.ids(max(0, low), high).astype(np.int64) for low, high in zip(spans_.field("low").to_pylist(), spans_.field("high").to_pylist())]
                yield pa.RecordBatch.from_arrays([spans_.field("name"), spans_.field("at"), pa.array(found, pa.list_(pa.int64()))], names=["name", "at", "part"])

    pieces = packs.select("part", "pack", "data").join(asked, ["part", "pack"]).select("data", "asked").mapInArrow(run, f"name {kind}, at long, part array<long>")
    whole = pieces.groupBy("name").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids"))
    return spans.select("name").join(whole, "name", "left").select("name", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def read(packs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document of written packs, from their bytes: key, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it; ids_crc32 is the checksum of its
    ids as little-endian 32-bit integers.
    """
    kind = packs.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = Pack(batch["data"][i].as_py())
                ids = one.ids().astype("<u4")
                lengths = one.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                crc = np.fromiter((zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths)), np.int64, len(ends))
                n = len(ends)
                part, pack_ = pa.array(np.full(n, batch["part"][i].as_py(), np.int32)), pa.array(np.full(n, batch["pack"][i].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([part, pack_, batch["keys"][i].values, pa.array(ends - lengths), pa.array(lengths), pa.array(crc)], names=["part", "pack", "key", "first", "n_tokens", "ids_crc32"])

    starts = _starts(packs).select("part", "pack", "before")
    out = packs.select("part", "pack", "keys", "data").mapInArrow(run, f"part int, pack int, key {kind}, first long, n_tokens long, ids_crc32 long")
    out = out.join(starts, ["part", "pack"])
    return out.select(F.col("key").alias(key), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, scratch: Scratch, tokenizer: str, n_ids: int, end: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as packs and read them back."""
    return read(write(docs, scratch.path("packs"), tokenizer, n_ids, end, key, text), key)
