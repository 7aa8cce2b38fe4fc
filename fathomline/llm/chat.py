"""Conversations as training windows of a token budget, with a loss mask.

The template marks every turn, so a window can be read back:

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  <s>text</s>
    other      [TURN]role\\ttext[/TURN]

A newline ends every turn, so that no token reaches from one turn into the next and
a window has as many tokens as its turns together, marks and escapes included.
Control strings, backslashes and, in roles, tabs are escaped inside texts as a
backslash and a letter; undoing that gives the text back exactly.

A conversation is cut between turns. Running sums of the turns' tokens tell how
many turns fit a window beside what it repeats: the system turn, always, and as
many of the turns just before as fit the history budget. The loss mask covers
the text of each assistant turn in the one window that has it for the first
time; in repeated history it is masked out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.bpe import counter

_CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[TURN]", "[/TURN]")
_LETTERS = "YyIiSsTt"
_OUT = {**{c: "\\" + x for c, x in zip(_CONTROL, _LETTERS)}, "\\": "\\\\", "\t": "\\-"}
_IN = {v[1]: k for k, v in _OUT.items()}
_ESCAPE = re.compile("|".join(re.escape(c) for c in (*_CONTROL, "\\")))
_ESCAPE_ROLE = re.compile("|".join(re.escape(c) for c in (*_CONTROL, "\\", "\t")))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_TURN = re.compile(r"(<<SYS>>|\[INST\]|<s>|\[TURN\])(.*?)(<</SYS>>|\[/INST\]|</s>|\[/TURN\])", re.S)
_ROLE = {v[0]: k for k, v in _MARKS.items()}
WINDOW_SCHEMA = "window int, repeated int, turns int, tokens long, text string, loss array<struct<start:int,end:int>>"
BUDGET, HISTORY = 1024, 256


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _IN[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Opening mark, escaped text, and closing mark with a newline of a turn."""
    if role in _MARKS:
        return _MARKS[role][0], escape(text), _MARKS[role][1] + "\n"
    return "[TURN]" + _ESCAPE_ROLE.sub(lambda m: _OUT[m[0]], role) + "\t", escape(text), "[/TURN]\n"


def parse(window: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a window."""
    out = []
    for mark, body, _ in _TURN.findall(window):
        role = _ROLE.get(mark)
        if role is None:
            role, _, body = body.partition("\t")
            role = unescape(role)
        out.append((role, unescape(body)))
    return out


class Windows:
    """The windows of one conversation, made as its turns come; holds the open window and its history only."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, tuple[str, str, str], int] | None = None
        self.turns: list[tuple[str, tuple[str, str, str]]] = []
        self.sums = [0]  # running sums of their tokens
        self.first = self.new = self.made = 0  # of the turns held, the first one shown, and the first one not shown before
        self.place = -1  # of the system turn among them

    def _tokens(self) -> int:
        """Tokens of what the window shows: turns from the first one on, and the system turn if it isn't among them."""
        return self.sums[-1] - self.sums[self.first] + (self.system[2] if self.system and self.place < self.first else 0)

    def add(self, role: str, parts: tuple[str, str, str], tokens: int) -> dict | None:
        """Take a turn; returns the window that it didn't fit any more, if so."""
        closed = None
        if len(self.turns) > self.new and self._tokens() + tokens > self.budget:
            closed = self.close()
        while self.first < self.new and self._tokens() + tokens > self.budget:
            self.first += 1  # rather less history than a window over its budget
        if role == "system" and self.system is None:
            self.system, self.place = (role, parts, tokens), len(self.turns)
        self.turns.append((role, parts))
        self.sums.append(self.sums[-1] + tokens)
        return closed

    def close(self) -> dict | None:
        """The open window; its last turns become the next one's history."""
        if len(self.turns) == self.new:
            return None
        shown, repeated, tokens = self.turns[self.first :], self.new - self.first, self._tokens()
        if self.system and self.place < self.first:
            shown.insert(0, self.system[:2])
            repeated += 1
        text, loss, at = [], [], 0
        for i, (role, (before, inner, after)) in enumerate(shown):
            if role == "assistant" and i >= repeated:
                loss.append({"start": at + len(before), "end": at + len(before) + len(inner)})
            text += [before, inner, after]
            at += len(before) + len(inner) + len(after)
        out = {"window": self.made, "repeated": repeated, "turns": len(shown), "tokens": tokens, "text": "".join(text), "loss": loss}
        self.made += 1
        while self.first < len(self.turns) and self.sums[-1] - self.sums[self.first] > self.history:
            self.first += 1
        del self.turns[: self.first], self.sums[: self.first]
        self.place, self.first, self.new = max(-1, self.place - self.first), 0, len(self.turns)
        return out


def _rows(batches: Iterator[pa.RecordBatch], make: Callable, names: list[str], schema: pa.Schema, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Feed rows to make(), which returns finished rows, and put these into batches of about size characters."""
    held, weight = [], 0
    for batch in batches:
        for row in zip(*(batch[n].to_pylist() for n in names)):
            for out in make(row):
                held.append(out)
                weight += len(out.get("text", "")) + 64
                if weight >= size:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, weight = [], 0
    held += make(None)
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_conversations(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: conv, window (from 0), repeated (leading turns repeated), turns, tokens, text, loss (spans of text).

    Turns are in the order of turn, role and text. Null texts and roles are empty;
    null conversation ids are one conversation. Every turn is in one window as new,
    repeated rows too. tokens counts the whole text of a window, and is at most the
    budget. Only a turn that goes over it together with the system turn is not cut:
    its window has these two alone. An empty table gives no windows; other columns
    are not read. Rows are shuffled once by conversation and sorted; a task holds one
    open window at a time, whatever the length of a conversation.
    """
    kind = turns.schema[conv].dataType.simpleString()
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"conv {kind}, {WINDOW_SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        state: dict = {"conv": None, "open": None}

        def make(row) -> list[dict]:
            out = []
            if state["open"] is not None and (row is None or row[0] != state["conv"]):
                if last := state["open"].close():
                    out.append({"conv": state["conv"], **last})
                state["open"] = None
            if row is not None:
                if state["open"] is None:
                    state["conv"], state["open"] = row[0], Windows(budget, history)
                parts = format_turn(row[1], row[2])
                if closed := state["open"].add(row[1], parts, count("".join(parts))):
                    out.append({"conv": row[0], **closed})
            return out

        yield from _rows(batches, make, ["conv", "role", "text"], arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    placed = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return placed.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, from its windows' text and mask: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = windows.schema[conv].dataType.simpleString()
    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def make(row) -> list[dict]:
            out = []
            if state and (row is None or row[0] != state["conv"]):
                out.append({**state, "turns_sha256": state["turns_sha256"].hexdigest(), "loss_sha256": state["loss_sha256"].hexdigest()})
                state.clear()
            if row is not None:
                key, repeated, text, loss = row
                if not state:
                    state.update(conv=key, n_turns=0, turns_sha256=hashlib.sha256(), loss_chars=0, loss_sha256=hashlib.sha256(), formatted_chars=0)
                for role, body in parse(text)[repeated:]:
                    state["n_turns"] += 1
                    state["turns_sha256"].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state["loss_chars"] += len(target)
                    state["loss_sha256"].update(target.encode())
                state["formatted_chars"] += len(text)
            return out

        yield from _rows(batches, make, ["conv", "repeated", "text", "loss"], arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    rows = windows.select(F.col(conv).alias("conv"), "window", "repeated", "text", "loss")
    placed = rows.repartition("conv").sortWithinPartitions("conv", "window").drop("window")
    return placed.mapInArrow(run, schema).withColumnRenamed("conv", conv)
