"""Repaired conversations against a plain search over all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from conftest import SF
from fathomline.llm import dialogue
from fathomline.llm.store import Scratch

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0d]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """rows in order; cost, audit and what is left: the least (cost, audit) of all sequences of edits."""
    wrong = faults(rows)

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts:
            for role in ("user", "assistant"):
                if to := STEP.get((state, role[0])):
                    cost, audit, left = best(i, to, inserts - 1)
                    found.append((cost + 3, "I" + audit, ((role, ""), *left)))
        if i < len(rows):
            role, text = rows[i][2:]
            cost, audit, left = best(i + 1, state, 3)
            found.append((cost + 4, "D" + audit, left))
            if wrong[i] not in ("blank", "duplicate"):
                extra = 3 if wrong[i] else 0
                for edit, new, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    if to := STEP.get((state, new[:1])):
                        cost, audit, left = best(i + 1, to, 3)
                        found.append((cost + price + extra, edit + audit, ((new, text), *left)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 3)


def plain(original, key=lambda text: hashlib.sha256(text.encode()).digest()):
    out = []
    damaged = plain_damage(original)
    for conv in {r[0] for r in original}:
        rows = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), key(r[3])))
        wrong, turns = faults(rows), {r[1] for r in rows} - {None}
        cost, audit, left = plain_repair(rows)
        initials = [r[2][:1] for r in rows]
        out.append(
            (
                conv,
                max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                *(wrong.count(k) for k in ("blank", "duplicate", "truncated")),
                sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                cost,
                audit,
                hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, parts=3):
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "copies", "mark", "kind", "_conv", "audit", "fault", "place")})
    got = dialogue.repaired(dialogue.damage(turns.repartition(parts)), Scratch(spark, "d"))
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def odd_rows():
    rng = random.Random(5)
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.95:
                text = rng.choice(["Yes.", "No!", "why?", "unfinished", " ", "\t\n", "", None, f"text {rng.random()}.", "x. \n", "…", "Yes."])
                rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Sys", "us"]), text))
    return rows + rows[:20] + [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, "system", "c."), (-5, None, None, None)]


def test_repairs_of_odd_rows(spark):
    check(spark, odd_rows())


def test_a_long_conversation_is_spread_over_tasks(spark):
    rng = random.Random(6)
    rows = [(1, t if t > 40 else None, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "again."])) for t in range(600)] + [(2, 1, "user", "a.")]
    sys.setrecursionlimit(10_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = dialogue.chunks(dialogue.distinct_turns(dialogue.damage(spark.createDataFrame(rows, SCHEMA)), Scratch(spark, "d")))
        assert made.where("conv = 1").count() > 1
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_turn_over_and_over(spark):
    check(spark, [(7, 3, "user", "same.")] * 200 + [(7, 4, "assistant", "end."), (8, 1, "user", "x")] * 2)


def test_repairs_of_nothing(spark):
    got = dialogue.repaired(dialogue.damage(spark.createDataFrame([], SCHEMA)), Scratch(spark, "d"))
    assert got.columns == COLUMNS and got.count() == 0


def test_repaired_turns_are_a_conversation(spark):
    rows = odd_rows()
    done = dialogue.repair(dialogue.damage(spark.createDataFrame(rows, SCHEMA)), Scratch(spark, "d"))
    said = {}
    for r in done.turns.collect():
        said.setdefault(r["conv"], {})[r["place"]] = r["role"][:1]
    for turns in said.values():
        assert sorted(turns) == list(range(len(turns)))
        assert re.fullmatch("s?(ua)+", "".join(turns[i] for i in sorted(turns)))


@pytest.mark.parametrize("seed", range(20))
def test_checkpoints_and_chunks_agree_with_all_vectors(seed):
    rng = random.Random(seed)
    codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 11]) for _ in range(rng.randint(0, 60)))
    whole, v = dialogue.Checkpoints(codes, dialogue.END), dialogue.END
    vectors = [v]
    for code in reversed(codes):
        vectors.append(v := dialogue.back(code, v))
    vectors.reverse()
    assert len(whole.kept) <= 2 * max(1, len(codes)) ** 0.5 + 3
    for low, block in whole.blocks():
        assert block == vectors[low : low + len(block)]
    cut = rng.randint(0, len(codes))
    after = dialogue.through(dialogue.matrix(codes[cut:]), dialogue.END)
    first, state = dialogue.Checkpoints(codes[:cut], after).walk(0, False)
    second, _ = dialogue.Checkpoints(codes[cut:], dialogue.END).walk(state, True)
    assert first + second == whole.walk(0, True)[0]


def test_given_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)
