"""Repair of conversation structure by a shortest path with checkpoints.

A conversation may be empty, or user and assistant take turns, the assistant last,
perhaps after one system turn. Edits of least cost lead there; of several such
sequences of edits the least by ASCII is taken. The costs from each place to the end
are a vector over the grammar's four states. Vectors are stored only at checkpoints,
about as many as there are turns between two of them; walking forward, those of one
block are computed again from the checkpoint behind it.

Turns are sorted by ranges, so a long conversation is spread over tasks. Each task
makes a chunk of it: one byte for each turn, and the costs between the states at its
ends. Folding these from the end gives the vector behind each chunk, the outer
checkpoints; then all chunks are walked at once, from every state they may be
entered in, and the walks are joined from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.store import Scratch

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, and after a system, user or assistant turn. STEP: the state after each initial.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
#: In each state the initial that an inserted or changed turn gets.
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
INITIALS = "sua"
NEVER = 1 << 50
#: A turn is a byte: its initial (3: another), and 4 if truncated, 8 if it must go.
CUT, GONE = 4, 8
_LEGAL = ("su", "ua", "au")

Vector = tuple[int, int, int, int]


def closed(v: list[int]) -> Vector:
    """Costs if turns may also be inserted here."""
    user, assistant = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + user), min(v[1], INSERT + user), user, assistant


END = closed([0, NEVER, NEVER, 0])


@lru_cache(None)
def _choices(code: int) -> tuple[tuple[int, int, str, int], ...]:
    """(state, cost, edit, next state) of all edits of a turn."""
    out = [(s, DELETE, "D", s) for s in range(4)]
    if code < GONE:
        initial, extra = code & 3, TRUNCATED if code & CUT else 0
        for s in range(4):
            if initial < 3 and (s, INITIALS[initial]) in STEP:
                out.append((s, extra, "K", STEP[s, INITIALS[initial]]))
            out.append((s, extra + REROLE, "R", STEP[s, NEXT[s]]))
    return tuple(out)


def back(code: int, after: Vector) -> Vector:
    """Costs to the end before a turn, from those after it."""
    v = [NEVER] * 4
    for state, cost, _, to in _choices(code):
        if cost + after[to] < v[state]:
            v[state] = cost + after[to]
    return closed(v)


def matrix(codes: bytes) -> list[Vector]:
    """For each state behind these turns the costs that lead to it from each state before them."""
    out = []
    for end in range(4):
        v: Vector = tuple(0 if s == end else NEVER for s in range(4))
        for code in reversed(codes):
            v = back(code, v)
        out.append(v)
    return out


def through(table: list[Vector], after: Vector) -> Vector:
    """Costs before a chunk with this matrix."""
    return tuple(min(table[end][s] + after[end] for end in range(4)) for s in range(4))


class Checkpoints:
    """Cost vectors of a run of turns, stored at every block's end; a block is about the square root of the run."""

    def __init__(self, codes: bytes, after: Vector):
        self.codes, self.block = codes, max(1, isqrt(len(codes)))
        self.kept = {len(codes): after}
        v = after
        for i in range(len(codes) - 1, -1, -1):
            v = back(codes[i], v)
            if i % self.block == 0:
                self.kept[i] = v
        self.first = v

    def blocks(self) -> Iterator[tuple[int, list[Vector]]]:
        """Start of each block with the vectors from there to its end."""
        for low in range(0, len(self.codes), self.block):
            high = min(low + self.block, len(self.codes))
            vectors = [self.kept[high]]
            for i in range(high - 1, low - 1, -1):
                vectors.append(back(self.codes[i], vectors[-1]))
            yield low, vectors[::-1]

    def walk(self, state: int, last: bool) -> tuple[str, int]:
        """The ASCII-least edits from this state that keep to the least costs, and the state they end in. last: the conversation ends here."""
        edits = []
        for low, vectors in self.blocks():
            for i in range(len(vectors) - 1):
                here, after = vectors[i], vectors[i + 1]
                code = self.codes[low + i]
                while DELETE + after[state] != here[state] and INSERT + here[STEP[state, NEXT[state]]] == here[state]:
                    edits.append("I")
                    state = STEP[state, NEXT[state]]
                _, _, edit, state = min((x for x in _choices(code) if x[0] == state and x[1] + after[x[3]] == here[state]), key=lambda x: x[2])
                edits.append(edit)
        after = self.kept[len(self.codes)]
        while last and after[state]:
            edits.append("I")
            state = STEP[state, NEXT[state]]
        return "".join(edits), state


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns as conv, turn, role, text and copies, with faults that a checksum of conversation and turn decides.

    Of 20 remainders 0 drops the row (no copies), 1 empties its text, 2 takes its marks
    of sentence ends, 3 repeats it and 4 makes it a user's. Nulls are one space, in
    the checksum, the role and the text.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), name(role).alias("role"), name(text).alias("text"), kind.alias("kind"))
    marks = F.regexp_replace("text", "[.!?]", "")
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, marks).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def distinct_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns of one conversation, place, role and text as one row with their number, and with their fault: blank, duplicate, truncated or none.

    Copies behind the first are duplicates, unless they are blank. Whether a text was
    said before is found by its first turn; rows that meet here are all different, so
    no key is hot.
    """
    rows = turns.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    rows = rows.withColumn("mark", F.unhex(F.sha2("text", 256))).withColumn("_last", F.substring(bare, -1, 1))
    rows = scratch.save(rows, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.where("copies > 0").groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("mark").alias("_mark")).agg(F.min(place)["turn"].alias("_turn"))
    same = F.col("conv").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("role") == F.col("_role")) & (F.col("mark") == F.col("_mark"))
    met = rows.drop("text").join(firsts, same, "left")
    fault = F.when(F.col("_last") == "", "b").when(F.col("_role").isNull(), "d").when(~F.col("_last").isin(".", "!", "?"), "t").otherwise("o")
    return met.select("conv", "turn", "role", "mark", "copies", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


_STATS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


@dataclass
class Chunk:
    """A part of a conversation as it is read, in order."""

    conv: object
    codes: bytearray
    count: dict
    first: str | None = None
    low: object = None  # least turn that is not null
    last: tuple | None = None

    def add(self, turn, initial: str, copies: int, fault: str) -> None:
        if not copies:
            return
        own = GONE if fault in "bd" else CUT if fault == "t" else 0
        self.codes.append(own + (INITIALS.index(initial) if initial and initial in INITIALS else 3))
        self.codes += bytes([GONE + 3]) * (copies - 1)
        n = self.count
        n["rows"] += copies
        n["blank"] += copies if fault == "b" else 0
        n["duplicate"] += 0 if fault == "b" else copies if fault == "d" else copies - 1
        n["truncated"] += fault == "t"
        n["illegal"] += copies - 1 + (self.last is not None and self.last[1] + initial not in _LEGAL)
        n["turns"] += turn is not None and (self.last is None or self.last[0] != turn)
        self.first = initial if self.last is None else self.first
        self.low = turn if self.low is None else self.low
        self.last = (turn, initial)

    def row(self, chunk: int) -> dict:
        codes, (high, last) = bytes(self.codes), self.last or (None, None)
        ends = {"low_turn": self.low, "high_turn": high, "first_initial": self.first, "last_initial": last}
        return {"conv": self.conv, "chunk": chunk, "codes": codes, "matrix": [c for v in matrix(codes) for c in v], **self.count, **ends}


def _stream(schema: str, columns: list[str], make, size: int = 1 << 20):
    """mapInArrow's function: feed rows to make()(row), and None at the end; it returns finished rows, of which batches of about size characters are made."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held, weight = make(), [], 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in columns)):
                for out in step(row):
                    held.append(out)
                    weight += 64 + sum(len(v) for v in out.values() if isinstance(v, (str, bytes)))
                if weight >= size:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held, weight = [], 0
        held += step(None)
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return run


def chunks(turns: DataFrame) -> DataFrame:
    """The chunks of all conversations: turns dealt and sorted by ranges, a row for each conversation and task."""
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    schema = f"conv {kinds['conv']}, chunk long, codes binary, matrix array<long>, {', '.join(f'{c} long' for c in _STATS)}, low_turn {kinds['turn']}, high_turn {kinds['turn']}, first_initial string, last_initial string"

    def make():
        at, open_ = TaskContext.get().partitionId(), []

        def step(row):
            out = []
            if open_ and (row is None or row[0] != open_[0].conv):
                out.append(open_.pop().row(at))
            if row is not None:
                if not open_:
                    open_.append(Chunk(row[0], bytearray(), dict.fromkeys(_STATS, 0)))
                open_[0].add(*row[1:])
            return out

        return step

    order = ["conv", "turn", "role", "mark"]
    return turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(schema, ["conv", "turn", "initial", "copies", "fault"], make), schema)


def checkpoints(made: DataFrame) -> DataFrame:
    """For each chunk the costs behind it (after) and before it, and whether it is its conversation's first or last. Chunks of one conversation are no more than tasks."""
    schema = f"conv {made.schema['conv'].dataType.simpleString()}, chunk long, after array<long>, before array<long>, head boolean, tail boolean"

    def make():
        held: list[dict] = []

        def step(row):
            out = []
            new = not held or row is None or row[0] != held[0]["conv"]
            if held:
                out.append({**held.pop(), "head": new})
            if row is not None:
                after = END if new else tuple(out[0]["before"])
                table = [tuple(row[2][4 * i : 4 * i + 4]) for i in range(4)]
                held.append({"conv": row[0], "chunk": row[1], "after": after, "before": through(table, after), "tail": new})
            return out

        return step

    rows = made.select("conv", "chunk", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("chunk"))
    return rows.mapInArrow(_stream(schema, ["conv", "chunk", "matrix"], make), schema)


def walks(made: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks with edits and the state behind them, for each state that they may be entered in (the first one: only for 0)."""
    keys = known.select(F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk"), "after", "before", "head", "tail")
    met = made.join(keys, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))).drop("_conv", "_chunk", "matrix")
    kept = [c for c in met.columns if c not in ("codes", "after")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, ends = [], []
            for codes, after, head, tail in zip(*(batch[c].to_pylist() for c in ("codes", "after", "head", "tail"))):
                found = Checkpoints(codes, tuple(after))
                ways = [found.walk(state, tail) for state in range(1 if head else 4)]
                edits.append([w[0] for w in ways])
                ends.append([w[1] for w in ways])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(edits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], names=[*kept, "edits", "ends"])

    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in kept)
    return met.mapInArrow(run, f"{kinds}, edits array<string>, ends array<int>")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def joined(walked: DataFrame) -> DataFrame:
    """One row per conversation: its counts, the least cost and the edits (audit), from its chunks in order."""
    schema = f"conv {walked.schema['conv'].dataType.simpleString()}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string"
    columns = ["conv", "edits", "ends", "before", "low_turn", "high_turn", "first_initial", "last_initial", *_STATS[1:]]

    def make():
        open_: list[dict] = []

        def close() -> dict:
            x = open_.pop()
            gaps = 0 if x["high"] is None else x["high"] - x["low"] + 1 - x["turns"]
            return {"conv": x["conv"], "gaps": gaps, **{c: x[c] for c in _COUNTS[1:]}, "audit": "".join(x["audit"])}

        def step(row):
            out = []
            if open_ and (row is None or row[0] != open_[0]["conv"]):
                out.append(close())
            if row is None:
                return out
            conv, edits, ends, before, low, high, x, y, *numbers = row
            if not open_:
                open_.append({"conv": conv, "cost": before[0], "state": 0, "audit": [], "low": None, "high": None, "initial": None, **dict.fromkeys(_STATS, 0)})
            o = open_[0]
            o["audit"].append(edits[o["state"]])
            o["state"] = ends[o["state"]]
            for name, n in zip(_STATS[1:], numbers):
                o[name] += n
            if x is not None:
                o["illegal"] += o["initial"] is not None and o["initial"] + x not in _LEGAL
                o["initial"] = y
            if high is not None:
                o["turns"] -= low == o["high"]  # counted in both chunks
                o["low"] = low if o["low"] is None else o["low"]
                o["high"] = high
            return out

        return step

    rows = walked.repartition("conv").sortWithinPartitions("conv", "chunk")
    return rows.mapInArrow(_stream(schema, columns, make), schema)


@dataclass
class Repair:
    """conversations: conv, counts, cost, audit; turns: conv, place, role, text of what the edits leave, ordered by conv and place within each task."""

    conversations: DataFrame
    turns: DataFrame


def repair(turns: DataFrame, scratch: Scratch) -> Repair:
    """Repair turns of conv, turn, role, text, copies (as damage() gives them): cheapest edits, and what they make of the turns.

    A conversation's turns are in the order of turn (null first), role and a digest of
    the text, repeated ones side by side. Each turn's first fault counts: blank,
    duplicate (the same role and text before it), truncated (its last character is
    no end of a sentence). Blank and duplicate turns go. Roles tell by their first
    letter, others than s, u, a fit nowhere. A null conversation is one of its own;
    one of which all turns are dropped has zeros, no edits and no turns. An empty
    table gives empty results; other columns are not read.

    Only writing the repaired turns reads a conversation from its first turn to its
    last in one task, as a stream: one turn is in memory, and the edits of its own
    conversation, a byte each.
    """
    found = distinct_turns(turns, scratch)
    made = scratch.save(chunks(found), "chunks")
    known = scratch.save(checkpoints(made), "checkpoints")
    conversations = scratch.save(joined(walks(made, known)), "conversations")
    said = turns.sparkSession.read.parquet(scratch.path("turns")).where("copies > 0")
    stream = said.select("conv", F.lit(1).alias("kind"), "turn", "role", "mark", "text", "copies", F.lit(None).cast("string").alias("audit"))
    null = lambda c: F.lit(None).cast(said.schema[c].dataType).alias(c)
    stream = stream.unionByName(conversations.select("conv", F.lit(0).alias("kind"), *map(null, ("turn", "role", "mark", "text", "copies")), "audit"))
    stream = stream.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "mark")
    schema = f"conv {said.schema['conv'].dataType.simpleString()}, place long, role string, text string"
    return Repair(conversations, stream.mapInArrow(_stream(schema, ["conv", "kind", "role", "text", "copies", "audit"], _editor), schema))


def _editor():
    """Applies a conversation's edits, which come first, to its turns."""
    at: dict = {"audit": "", "next": 0, "state": 0, "place": 0, "conv": None}

    def put(role: str, text: str) -> dict:
        at["state"] = STEP[at["state"], role[:1]]
        at["place"] += 1
        return {"conv": at["conv"], "place": at["place"] - 1, "role": role, "text": text}

    def inserted() -> list[dict]:
        out = []
        while at["next"] < len(at["audit"]) and at["audit"][at["next"]] == "I":
            at["next"] += 1
            out.append(put(ROLES[NEXT[at["state"]]], ""))
        return out

    def step(row):
        if row is None or row[1] == 0:
            out = inserted()
            if row is not None:
                at.update(audit=row[5], next=0, state=0, place=0, conv=row[0])
            return out
        out = []
        for _ in range(row[4]):
            out += inserted()
            edit = at["audit"][at["next"]]
            at["next"] += 1
            if edit == "K":
                out.append(put(row[2], row[3]))
            elif edit == "R":
                out.append(put(ROLES[NEXT[at["state"]]], row[3]))
        return out

    return step


def digests(turns: DataFrame) -> DataFrame:
    """conv and repaired_sha256, the digest of ``role:text`` of its repaired turns, joined by line feeds."""
    schema = f"conv {turns.schema['conv'].dataType.simpleString()}, repaired_sha256 string"

    def fold():
        state: dict = {}

        def step(row):
            out = []
            if state and (row is None or row[0] != state["conv"]):
                out.append({"conv": state["conv"], "repaired_sha256": state["made"].hexdigest()})
                state.clear()
            if row is not None:
                if state:
                    state["made"].update(b"\n")
                else:
                    state.update(conv=row[0], made=hashlib.sha256())
                state["made"].update(f"{row[1]}:{row[2]}".encode())
            return out

        return step

    return turns.mapInArrow(_stream(schema, ["conv", "role", "text"], fold), schema)


def repaired(turns: DataFrame, scratch: Scratch, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; see repair()."""
    done = repair(turns, scratch)
    made = digests(done.turns).select(F.col("conv").alias("_conv"), "repaired_sha256")
    out = done.conversations.join(made, F.col("conv").eqNullSafe(F.col("_conv")), "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(F.col("conv").alias(conv), *_COUNTS, "audit", F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
