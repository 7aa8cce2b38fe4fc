"""Secrets in texts: fixed rules, and a character convolutional network over every candidate.

A candidate is a longest run of 16 or more of the characters that keys are made of. It
is seen as a window of 96 bytes: up to 24 before it, 48 of its own and what follows;
a longer one is several windows and scores as its highest. The network embeds
characters, convolves five at a time, pools inside the candidate and around it, and
is trained on all different candidates (first windows), labelled by the rules, and on drawn ones: keys
and harmless runs in the context of every candidate, half of all contexts blanked, so that it
learns what keys look like and not only what announces them. Tasks learn from their rows
side by side, and the mean of their networks goes on. Its scores are calibrated on all
held-out examples, and the threshold keeps the recall of every kind of findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.store import Scratch
from fathomline.llm.words import blocks, buffers

KINDS, ADDED = ("assign", "access", "hex"), "net"
_ANNOUNCED = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ASSIGN = re.compile(_ANNOUNCED + r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_RUN = 6, 20, 24, 16
BEFORE, INSIDE, AFTER = 24, 48, 24
WIDTH = BEFORE + INSIDE + AFTER
#: Windows of a long candidate start so many bytes apart.
STRIDE = 32


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_RUN = _table(_LETTERS + _LETTERS.upper() + "0123456789+/_=-")
_HEX = _table("0123456789abcdef")


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points of what the rules find: matches from the left, without those that are too short."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(out)


def _runs(data: np.ndarray, at: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last byte (exclusive) of the longest runs of these bytes; at: where texts start, and the end."""
    edge = np.zeros(len(data) + 1, np.int8)
    inside = table[data]
    edge[:-1] = inside
    edge[1:] -= inside
    starts, ends = edge == 1, edge == -1
    joint = at[1:-1]
    joint = joint[(joint > 0) & (joint < len(data))]
    joint = joint[inside[joint - 1] & inside[joint]]
    starts[joint] = ends[joint] = True  # a run ends with its text
    a, b = np.flatnonzero(starts), np.flatnonzero(ends)
    long_ = b - a >= least
    a, b = a[long_], b[long_]
    return np.searchsorted(at, a, "right") - 1, a, b


def _windows(data: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The window of each piece from a to b, of at most INSIDE bytes, in a text from low to high; first column: bytes of the piece."""
    if len(a) > 4096:
        return np.concatenate([_windows(data, *(x[i : i + 4096] for x in (low, high, a, b))) for i in range(0, len(a), 4096)])
    where = a[:, None] + np.arange(-BEFORE, INSIDE + AFTER)
    seen = (where >= low[:, None]) & (where < np.minimum(high, b + AFTER)[:, None])
    out = np.zeros((len(a), 1 + WIDTH), np.uint8)
    out[:, 0] = b - a
    out[:, 1:] = np.where(seen, data[np.clip(where, 0, max(0, len(data) - 1))], 0)
    return out


def _found(texts: pa.Array) -> Iterator[tuple[list, list]]:
    """For each text of one block its rule spans and its candidates (start, end, windows)."""
    offsets, raw = buffers(texts)
    at = offsets - offsets[0]
    data = raw[offsets[0] : offsets[-1]]
    codes = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=codes[1:])  # code points before each byte
    spans: list[list] = [[] for _ in range(len(texts))]
    told = pc.fill_null(pc.or_(pc.match_substring_regex(texts, _ANNOUNCED, ignore_case=True), pc.match_substring(texts, "AKIA")), False)
    told = told.to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(told).tolist():
        spans[i] = [s for s in rule_spans(texts[i].as_py()) if s[1] < 2]
    for i, a, b in zip(*(x.tolist() for x in _runs(data, at, _HEX, LEAST_HEX))):
        spans[i].append((int(codes[a] - codes[at[i]]), 2, int(codes[b] - codes[at[i]])))
    candidates: list[list] = [[] for _ in range(len(texts))]
    text, a, b = _runs(data, at, _RUN, LEAST_RUN)
    pieces = np.maximum(1, -(-(b - a - INSIDE) // STRIDE) + 1)
    # a few thousand windows at once
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(pieces) // 4096)) + 1):
        if not len(part):
            continue
        owner = np.repeat(part, pieces[part])
        number = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(pieces[part])[:-1]], pieces[part])
        start = a[owner] + number * STRIDE
        made = _windows(data, at[text[owner]], at[text[owner] + 1], start, np.minimum(start + INSIDE, b[owner]))
        for run, rows in zip(part.tolist(), np.split(made, np.cumsum(pieces[part])[:-1])):
            first = codes[at[text[run]]]
            candidates[text[run]].append((int(codes[a[run]] - first), int(codes[b[run]] - first), rows.tobytes()))
    yield from ((sorted(s), c) for s, c in zip(spans, candidates))


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_CANDIDATE = "array<struct<start:int,end:int,kind:int,windows:binary>>"


def _overlap(start: int, end: int, spans: list) -> int:
    """Kind of the first span that meets this one, -1 if none does."""
    return next((k for a, k, b in spans if a < end and start < b), -1)


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans of the rules and candidates with the kind of the span that they overlap (-1: none), for each row of docs. Texts are read once, here."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        candidate = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("windows", pa.binary())]))
        for batch in batches:
            for low, high in blocks(batch["text"]):
                spans, candidates = [], []
                for s, c in _found(batch["text"][low:high]):
                    spans.append([{"start": a, "kind": k, "end": b} for a, k, b in s])
                    candidates.append([{"start": a, "end": b, "kind": _overlap(a, b, s), "windows": w} for a, b, w in c])
                yield pa.RecordBatch.from_arrays([batch["key"][low:high], pa.array(spans, span), pa.array(candidates, candidate)], names=["key", "spans", "candidates"])

    return rows.mapInArrow(run, f"key {kind}, spans {_SPAN}, candidates {_CANDIDATE}")


# the network

_CODE = np.full(256, 97, np.uint8)  # not ASCII
_CODE[:128] = 1  # control characters
_CODE[32:127] = np.arange(2, 97)
_CODE[0] = 0
EMBEDDED, FILTERS, SPAN = 8, 16, 5


class Network:
    """Embedding, one convolution, three poolings and a logistic output."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.parts = {
            "embed": normal(98, EMBEDDED, scale=0.5),
            "filters": normal(SPAN * (EMBEDDED + 1), FILTERS, scale=0.2),
            "bias": np.zeros(FILTERS, np.float32),
            "out": normal(3 * FILTERS, scale=0.2),
            "level": np.zeros(1, np.float32),
        }

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logit of each window, and what backward() needs."""
        p, codes = self.parts, _CODE[windows[:, 1:]]
        place = np.arange(WIDTH)
        inside = ((place >= BEFORE) & (place < BEFORE + windows[:, :1].astype(int))).astype(np.float32)
        x = np.concatenate([p["embed"][codes] * (codes > 0)[..., None], inside[..., None]], axis=2)
        runs = np.lib.stride_tricks.sliding_window_view(x, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - SPAN + 1, -1)
        h = np.maximum(runs @ p["filters"] + p["bias"], 0)
        own = inside[:, SPAN // 2 : WIDTH - SPAN // 2, None]
        within, around = h * own, h * (1 - own)
        count = np.maximum(own.sum(axis=1), 1)
        pooled = np.concatenate([within.max(axis=1), within.sum(axis=1) / count, around.max(axis=1)], axis=1)
        return pooled @ p["out"] + p["level"][0], (codes, runs, h, own, count, within, around, pooled)

    def backward(self, slope: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        """Gradients, from the loss's slope by each logit."""
        codes, runs, h, own, count, within, around, pooled = kept
        p, n = self.parts, np.arange(len(slope))
        dp = slope[:, None] * p["out"]
        dh = dp[:, None, FILTERS : 2 * FILTERS] / count[:, None] * own
        f = np.arange(FILTERS)
        for values, part, mask in ((within, dp[:, :FILTERS], own), (around, dp[:, 2 * FILTERS :], 1 - own)):
            top = values.argmax(axis=1)
            dh[n[:, None], top, f] += part * mask[n[:, None], top, 0]
        dh *= h > 0
        flat = dh.reshape(-1, FILTERS)
        druns = (dh @ p["filters"].T).reshape(len(slope), dh.shape[1], SPAN, EMBEDDED + 1)
        dx = np.zeros((len(slope), WIDTH, EMBEDDED), np.float32)
        for i in range(SPAN):
            dx[:, i : i + dh.shape[1]] += druns[:, :, i, :EMBEDDED]
        dx *= (codes > 0)[..., None]
        embed = np.stack([np.bincount(codes.ravel(), dx[..., e].ravel(), 98) for e in range(EMBEDDED)], axis=1)
        return {"embed": embed.astype(np.float32), "filters": runs.reshape(-1, runs.shape[2]).T @ flat, "bias": flat.sum(axis=0), "out": pooled.T @ slope, "level": slope.sum(keepdims=True)}

    def fit(self, batches: Iterable[tuple[np.ndarray, np.ndarray]], weights: tuple[float, float], rate: float = 0.01, decay: float = 1e-4) -> int:
        """Adam on the log loss, over batches of windows and labels; weights: those of the labels 0 and 1. Gives the number of rows."""
        first, second = ({k: np.zeros_like(v) for k, v in self.parts.items()} for _ in range(2))
        rows = 0
        for step, (windows, labels) in enumerate(batches, 1):
            rows += len(labels)
            logit, kept = self.forward(windows)
            slope = ((_probability(logit) - labels) * np.where(labels == 1, weights[1], weights[0]) / len(labels)).astype(np.float32)
            for k, g in self.backward(slope, kept).items():
                g = g + decay * self.parts[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.parts[k] = (self.parts[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return rows

    def logits(self, windows: np.ndarray, at_once: int = 512) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(windows[i : i + at_once])[0] for i in range(0, len(windows), at_once))])


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def calibration(logit: np.ndarray, label: np.ndarray, count: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and level of the logistic curve from logits (each count times, default once) to probabilities of a finding, by Newton steps, with targets a little inside 0 and 1."""
    count = np.ones(len(logit)) if count is None else count
    n1, n0 = (count * label).sum(), (count * (1 - label)).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([logit.astype(float), np.ones(len(logit))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _probability(x @ w)
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (count * (p - target)) + 1e-3 * (w - [1, 0]))
        w = w - np.clip(step, -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


@dataclass
class Model:
    """The network, its calibration, the probability from which on a candidate is a secret, and of held-out findings: by kind the threshold that keeps the recall; recall and precision at the one used; and by kind the number of examples, learned from or held out."""

    network: Network
    slope: float
    level: float
    threshold: float
    thresholds: dict[str, float]
    recall: float
    precision: float
    examples: dict[str, int]

    def scores(self, windows: np.ndarray) -> np.ndarray:
        return _probability(self.slope * _rounded(self.network.logits(windows)) + self.level)


def _rounded(logit: np.ndarray) -> np.ndarray:
    """Logits in thousandths, so that those of any number of rows can be counted."""
    return np.round(np.clip(logit.astype(float), -30, 30), 3)


_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", _LETTERS.upper() + "0123456789", _LETTERS + "0123456789", _LETTERS + _LETTERS.upper() + "0123456789", _LETTERS + _LETTERS.upper() + "0123456789+/", _LETTERS + _LETTERS.upper() + "0123456789_-")


def _draw(rng: np.random.Generator, is_key: bool, style: int, words: list[bytes], context: np.ndarray) -> np.ndarray:
    """A key, or a harmless run of one of four styles, as a window in this context."""
    pick = lambda options: options[rng.integers(len(options))]
    size = int(rng.integers(LEAST_RUN, INSIDE + 1))
    if is_key:
        alphabet = pick(_ALPHABETS)
        value = "".join(alphabet[j] for j in rng.integers(0, len(alphabet), size)).encode()
    elif style < 2:
        mark = pick([b"-", b"_", b"/", b""] if style else [b""])
        value = b""
        while len(value) < size:
            value += (mark if value else b"") + pick(words)
        value = pick([bytes.lower, bytes.upper, bytes.title, bytes])(value[:INSIDE])
    elif style == 2:
        value = "".join(str(j) for j in rng.integers(0, 10, min(size, 20))).encode()
    else:
        value = pick([b"-", b"=", b"_", b"x", b"a", b"0", b"/"]) * size
    row = np.zeros(1 + WIDTH, np.uint8)
    row[0] = len(value)
    row[1 : 1 + BEFORE] = context[1 : 1 + BEFORE]
    row[1 + BEFORE : 1 + BEFORE + len(value)] = list(value)
    after = context[1 + BEFORE + context[0] : 1 + BEFORE + context[0] + AFTER]
    row[1 + BEFORE + len(value) : 1 + BEFORE + len(value) + len(after)] = after
    return row


def drawn(contexts: np.ndarray, words: list[bytes], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n keys and n harmless runs, as windows in these contexts: random characters of an alphabet, and words joined by marks, numbers, or one character over and over."""
    rng = np.random.default_rng(seed)
    out = [_draw(rng, i < n, i % 4, words, contexts[rng.integers(len(contexts))]) for i in range(2 * n)]
    return np.array(out), np.r_[np.ones(n), np.zeros(n)].astype(np.float32)


def _blanked(windows: np.ndarray) -> np.ndarray:
    """Windows without their contexts."""
    place = np.arange(WIDTH)
    inside = (place >= BEFORE) & (place < BEFORE + windows[:, :1].astype(int))
    return np.concatenate([windows[:, :1], windows[:, 1:] * inside], axis=1).astype(np.uint8)


_WORDS = ("the", "and", "config", "value", "section", "chapter", "transport", "station", "under", "standing", "international", "document", "readme", "index", "source", "page", "image", "table")
#: Kinds of examples: below the rules' own those that no rule finds and the harmless ones that were drawn, above them the drawn keys.
_UNFOUND, _HARMLESS, _KEY = -1, -2, len(KINDS)
_EXAMPLES = {_HARMLESS: "harmless", _UNFOUND: "unfound", **dict(enumerate(KINDS)), _KEY: "drawn"}


def examples(extracted: DataFrame, extra: int, seed: int, scratch: Scratch) -> DataFrame:
    """Windows and kinds: every different candidate once, and in the context of each a key or a harmless run that is drawn, ``extra`` of both at least in all. Half of them have no context."""
    first = F.substring(F.col("c.windows"), 1, 1 + WIDTH)
    rows = extracted.select(F.explode("candidates").alias("c")).select(first.alias("window"), F.col("c.kind").alias("kind"))
    rows = rows.groupBy("window").agg(F.max("kind").alias("kind")).withColumn("hash", F.xxhash64(F.lit(seed), "window"))
    rows, n = scratch.save_counted(rows, "different")
    if not n:  # drawn ones alone, without a context
        rows = extracted.sparkSession.range(1).select(F.lit(bytes(1 + WIDTH)).alias("window"), F.lit(_HARMLESS).alias("kind"), F.lit(0).cast("long").alias("hash"))
    copies = max(1, -(-2 * extra // max(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = [w.encode() for w in _WORDS]
        for batch in batches:
            windows, kinds = [], []
            for raw, kind, number in zip(*(batch[c].to_pylist() for c in ("window", "kind", "hash"))):
                rng = np.random.default_rng(number % 2**63)
                window = np.frombuffer(raw, np.uint8)
                words = common + (re.findall(rb"[A-Za-z]{3,12}", raw[1 + BEFORE : 1 + BEFORE + raw[0]]) if kind == _UNFOUND else [])
                made = [(window, kind)] if kind != _HARMLESS else []
                for style in (rng.integers(4) + np.arange(copies)) % 4:
                    is_key = bool(rng.integers(2))
                    made.append((_draw(rng, is_key, int(style), words, window), _KEY if is_key else _HARMLESS))
                for window, kind in made:
                    windows.append((_blanked(window[None])[0] if rng.integers(2) else window).tobytes())
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(kinds, pa.int32())], names=["window", "kind"])

    return rows.mapInArrow(run, "window binary, kind int").withColumn("held", F.pmod(F.xxhash64(F.lit(seed + 1), "window", "kind"), F.lit(3)) == 0)


def _matrix(windows: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(windows.to_pylist()), np.uint8).reshape(-1, 1 + WIDTH)


#: Rows of a task that learns, and the most tasks: beyond, each has more rows. Rows of a step.
TASK_ROWS, MOST_TASKS, BATCH = 16_384, 64, 64
#: Passes over few and over many rows, and the rows that are passed in all until the least number of passes does.
MOST_PASSES, LEAST_PASSES, PASSED = 20, 4, 150_000


def fit(rows: DataFrame, seed: int) -> Network:
    """The network learned from all rows (window, kind), both labels weighing the same.

    In each pass every task learns from its rows, in an order of its own, and the mean of
    the networks by rows goes on. Tasks stream their rows; those of a single task are passed in it.
    """
    label = F.col("kind") >= 0
    counts = rows.agg(F.count_if(~label).alias("n0"), F.count_if(label).alias("n1")).first()
    n = counts["n0"] + counts["n1"]
    weights = (0.5 * n / max(1, counts["n0"]), 0.5 * n / max(1, counts["n1"]))
    tasks = max(1, min(MOST_TASKS, -(-n // TASK_ROWS)))
    passes = max(LEAST_PASSES, min(MOST_PASSES, -(-PASSED // max(1, n))))
    network = Network(seed)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(windows: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from ((windows[i : i + BATCH], labels[i : i + BATCH]) for i in range(0, len(labels), BATCH))

        parts = ((_matrix(b["window"]), b["label"].to_numpy(zero_copy_only=False).astype(np.float32)) for b in batches if b.num_rows)
        if tasks > 1:
            seen = network.fit((step for part in parts for step in cut(*part)), weights)
        elif held := list(parts):
            windows, labels = (np.concatenate(x) for x in zip(*held))
            rng = np.random.default_rng(seed)
            orders = (rng.permutation(len(labels)) for _ in range(passes))
            seen = network.fit((step for order in orders for step in cut(windows[order], labels[order])), weights)
        else:
            seen = 0
        values = np.concatenate([v.ravel() for v in network.parts.values()])
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([values.tobytes()])], names=["seen", "parts"])

    for turn in range(passes if tasks > 1 else 1):
        order = F.xxhash64(F.lit(turn), "window", "kind").alias("order")
        dealt = rows.select("window", label.alias("label"), order).repartition(tasks, "order").sortWithinPartitions("order", "window", "label")
        got = dealt.mapInArrow(learn, "seen long, parts binary").where("seen > 0").collect()  # MOST_TASKS networks of some kilobytes
        if got:
            mean = np.average([np.frombuffer(r["parts"], np.float32) for r in got], axis=0, weights=[r["seen"] for r in got])
            at = np.cumsum([v.size for v in network.parts.values()])[:-1]
            network.parts = {k: v.reshape(network.parts[k].shape).astype(np.float32) for k, v in zip(network.parts, np.split(mean, at))}
    return network


def _judged(rows: DataFrame, network: Network, blank: bool) -> DataFrame:
    """rows (window, kind, held) with the network's logit, of what is left without the context if blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = _matrix(batch["window"])
            logit = _rounded(network.logits(_blanked(windows) if blank else windows))
            yield pa.RecordBatch.from_arrays([batch["window"], batch["kind"], batch["held"], pa.array(logit, pa.float64())], names=["window", "kind", "held", "logit"])

    return rows.select("window", "kind", "held").mapInArrow(run, "window binary, kind int, held boolean, logit double")


def train(extracted: DataFrame, scratch: Scratch, extra: int = 800, recall: float = 0.98, least: int = 20, seed: int = 17) -> Model:
    """The model learned from all labelled candidates of extracted.

    Every different candidate is an example, and as many are drawn, ``extra`` keys and harmless runs
    at least. A first network, of findings and drawn ones, leaves out candidates
    that no rule finds but that look like keys by themselves, as they may be either. A third is held out for the calibration and the thresholds: for
    each kind of finding with ``least`` held-out ones, the highest probability that
    ``recall`` of them reach; the lowest of these is used, 0.5 if there is none. Without
    any candidates the drawn ones alone are learned from.
    """
    rows = scratch.save(examples(extracted, extra, seed, scratch), "examples")
    # what the rules do not find may still be a key: it teaches only if a network without it takes it for harmless
    unfound = F.col("kind") == _UNFOUND
    sure = fit(rows.where(~unfound & ~F.col("held")), seed)
    harmless = _judged(rows.where(unfound), sure, blank=True).where("logit <= 0").drop("logit")
    rows = scratch.save(rows.where(~unfound).unionByName(harmless), "taught")
    network = fit(rows.where("NOT held"), seed)
    # logits are thousandths from -30 to 30, so their counts are few
    held = _judged(rows.where("held"), network, blank=False).groupBy("kind", "logit").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "logit").collect()
    kind, logit, count = (np.array([r[c] for r in held], t) for c, t in (("kind", int), ("logit", float), ("n", float)))
    positive = kind >= 0
    slope, level = calibration(logit, positive.astype(float), count)
    p = _probability(slope * logit + level)
    thresholds = {}
    for k in sorted(set(kind[positive].tolist())):
        upto = np.cumsum(count[kind == k])  # by rising logits
        if upto[-1] >= least:
            thresholds[_EXAMPLES[k]] = float(p[kind == k][np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")])
    threshold = min(thresholds.values(), default=0.5)
    said = p >= threshold
    right = count[said & positive].sum()
    sizes = {_EXAMPLES[r["kind"]]: r["count"] for r in rows.groupBy("kind").count().collect()}  # a row a kind
    return Model(network, slope, level, threshold, thresholds, float(right / max(1, count[positive].sum())), float(right / max(1, count[said].sum())), sizes)


def score(extracted: DataFrame, model: Model) -> DataFrame:
    """key and spans (kind, start, end, score) by start and kind: all of the rules, score 1, and candidates beside them from the model's threshold on."""
    kind = extracted.schema["key"].dataType.simpleString()
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[(s["start"], s["kind"], s["end"], 1.0) for s in spans] for spans in batch["spans"].to_pylist()]
            found = [(i, c) for i, cs in enumerate(batch["candidates"].to_pylist()) for c in cs if c["kind"] < 0]
            for low in range(0, len(found), 256):
                part = found[low : low + 256]
                sizes = [len(c["windows"]) // (1 + WIDTH) for _, c in part]
                p = model.scores(np.frombuffer(b"".join(c["windows"] for _, c in part), np.uint8).reshape(-1, 1 + WIDTH))
                for (i, c), best in zip(part, np.maximum.reduceat(p, np.r_[0, np.cumsum(sizes)[:-1]])):
                    if best >= model.threshold:
                        out[i].append((c["start"], len(KINDS), c["end"], float(best)))
            names = (*KINDS, ADDED)
            rows = [[{"kind": names[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(spans)] for spans in out]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(rows, schema)], names=["key", "spans"])

    return extracted.select("key", "spans", "candidates").mapInArrow(run, f"key {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>")


def find(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", **options) -> tuple[DataFrame, Model]:
    """key and spans for each row of docs, and the model that was learned from them (options: see train()).

    Positions count code points, the end exclusive. Null and empty texts have no spans;
    whole texts are searched, however long, and a candidate of any length is seen
    whole. Repeated rows and null keys are rows like others. Other columns of docs are
    not read, so their names do not matter. An empty table gives an empty result.
    """
    extracted = scratch.save(extract(docs, key, text), "extracted")
    model = train(extracted, scratch, **options)
    return score(extracted, model).withColumnRenamed("key", key), model


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of find(): key, n_assign, n_access, n_hex, base_sha256, spans as ``kind:start:end``, joined by commas; the digest is that of the rules' spans."""
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    own = F.filter("spans", lambda s: s["kind"] != ADDED)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(key, *counts, F.sha2(text(own), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
