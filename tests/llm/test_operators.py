"""Operators on hostile rows and on the smallest tables, against plain versions."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from fathomline.llm import bpe, chat, components, decontaminate, langid, minhash, mixing, packing, quality, queries, sharding, substrings, words
from fathomline.llm.store import Scratch
from llm.conftest import CLASH, CLASHES, edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def same_multiset(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


# words


def test_words_of_a_block():
    texts = ["one  two\nthree", None, "", "éa\x0bb", "x"]
    w = words.cut(pa.array(texts))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    again = words.cut(pa.array(["zz one two three", "x"]))
    assert again.hash[1] == w.hash[0] and again.windows(3)[1] == w.windows(3)[0] and again.hash[4] == w.hash[5]


# 1


def sets_of(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_of(rows, k, percent):
    """Plain version: every pair of texts; for each row with a key, the least key that its text's links lead to."""
    sets = [(i, sets_of(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for m, (j, b) in enumerate(sets[:n]):
            both = len(a & b)
            if i is not None and j is not None and both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(n), find(m)
                parent[max(x, y)] = min(x, y)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [None if i is None else least[find(n)] for n, (i, _) in enumerate(sets)]


def test_near_duplicates(spark, docs, empty):
    got = minhash.near_duplicates(docs, Scratch(spark, "t"), size=4).collect()
    expected = components_of([r[:2] for r in edge_rows()], 4, 80)
    same_multiset([(r["doc_id"], r["component_id"], r["kept"]) for r in got], [(r[0], c, r[0] is None or c == r[0]) for r, c in zip(edge_rows(), expected)])
    assert expected[1] == expected[2] == expected[3] == 1
    assert minhash.near_duplicates(empty, Scratch(spark, "t")).collect() == []


def test_large_groups_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 7, 9, 10, 12])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3, " ".join(w[: rng.randint(90, 150)] if rng.random() < 0.3 else w)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), size=4).collect()}
    assert [got[i] for i, _ in rows] == components_of(rows, 4, 80) and len(set(got.values())) > 20


class Counting(Scratch):
    """Counts the rows of all tables saved."""

    rows = 0

    def save(self, df, table):
        out = super().save(df, table)
        self.rows += out.count()
        return out


def test_work_grows_with_a_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_block_pairs", lambda members, percent, plain=minhash._block_pairs: made.save(plain(members, percent), "placed"))
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    counts = {}
    for n in (600, 2400):
        rows = [(0, " ".join(base))]
        for i in range(1, n):
            w = list(base)
            for _ in range(rng.choice([1, 2, 3, 3, 30])):
                w[rng.randrange(150)] = f"x{rng.randrange(10**9)}"
            rows.append((i, " ".join(w)))
        made = Counting(spark, "t")
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), made, size=4).collect()
        assert sum(r["component_id"] == 0 for r in got) > 0.7 * n
        counts[n] = made.rows
    assert counts[2400] < 4.4 * counts[600]


def test_repeated_keys_have_the_groups_of_their_texts(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (3, a), (3, b), (5, c), (5, c + " more"), (7, b + " b"), (2, None), (2, ""), (9, c)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(table, Scratch(spark, "t"), size=4).collect()
    same_multiset([(r["doc_id"], r["component_id"]) for r in got], list(zip((r[0] for r in rows), components_of(rows, 4, 80))))
    kept = [tuple(r) for r in minhash.deduplicate(table, Scratch(spark, "t"), size=4).collect()]
    assert Counter(t for _, t in kept if t) in (Counter([a, b, c]), Counter([a, b, c + " more"])) and len(kept) == 5
    assert {i for i, t in kept if t} == {1, 3, 5}


def test_superminhash_estimates_and_permutes():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8):
        a = rng.integers(0, 2**63, 400, dtype=np.uint64)
        b = np.concatenate([a[: int(400 * share)], rng.integers(0, 2**63, 400 - int(400 * share), dtype=np.uint64)])
        s = minhash.signatures([np.unique(a), np.unique(b)])
        truth = 400 * share / (800 - 400 * share)
        assert abs((s[0] == s[1]).mean() - truth) < 0.12
    ranks = minhash.signatures([np.array([12345], np.uint64)])[0] >> np.uint64(32)
    assert sorted(ranks.tolist()) == list(range(minhash.BANDS * minhash.ROWS))  # one item fills every slot once


def test_deduplicate_keeps_one_of_each(spark, docs):
    got = minhash.deduplicate(docs, Scratch(spark, "t"), size=4)
    assert got.columns == docs.columns
    ids = Counter(r["doc_id"] for r in got.select("doc_id").collect())
    expected = components_of([r[:2] for r in edge_rows()], 4, 80)
    assert ids == Counter({r[0]: 1 for r, c in zip(edge_rows(), expected) if r[0] == c and r[0] is not None}) + Counter({None: 2})


def test_components_with_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", 40)
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "x").collect()}
    sets = components.UnionFind()
    for a, b in links:
        sets.union(a, b)
    assert got == {x: sets.find(x) for x in list(sets.parent) if sets.find(x) != x}


# 2


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(0).integers(0, 2**64, 500, dtype=np.uint64)
    for n in (1, 2, 16, 17):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_shards(spark, docs, empty):
    got = sharding.assign(docs).collect()
    assert len(got) == len(edge_rows())
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16 and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    same_multiset([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows()])
    hashes = {r["doc_id"]: r["h"] % 2**64 for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    assert all((r["shard"], r["grown_shard"]) == (plain_jump(hashes[r["doc_id"]], 16), plain_jump(hashes[r["doc_id"]], 17)) for r in got)
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    by = defaultdict(list)
    for r in sharding.assign(named).collect():
        by[r["shard"]].append(r["slot"])
    assert sum(map(len, by.values())) == len(edge_rows()) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.assign(empty).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(docs, shards=0)


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 16)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert set(got.columns) == set(docs.columns)
    same_multiset([(r["doc_id"], r["shard"]) for r in got.select("doc_id", "shard").collect()], [(r["doc_id"], r["shard"]) for r in sharding.assign(docs).select("doc_id", "shard").collect()])


# 3


def test_token_counts(spark, docs, empty, library):
    got = bpe.token_counts(docs, TOKENIZER).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in edge_rows()]
    same_multiset([(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got], expected)
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert bpe.token_counts(empty, TOKENIZER).collect() == []


def test_counts_of_odd_texts(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 300)  # words are forgotten again and again
    rng = random.Random(1)
    letters = "ßǅªaAbzΣσİéÉ \t\n\x1c\x85\xa0\x01'.,?sLt<|>endoftext0९½#!​한中"
    count = bpe.Counter(TOKENIZER).count
    encode = packing.Encoder(TOKENIZER).encode
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>x"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert count(text) == len(ids) and encode([text, text], 2)[0].tolist() == (ids + [2]) * 2


# 4


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op4_hyperdimensional_language(spark, SF)
    met = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in met if r["held_out"]]
    assert len(met) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in met if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_languages_of_odd_rows(spark, docs, empty):
    model = langid.train(docs)
    assert model[0] == ["xx", "yy"]
    got = langid.predict(docs, model)
    assert [c for c in got.columns if c not in ("lang_pred", "score")] == [c for c in docs.columns if c not in ("lang_pred", "score")]
    for r in got.collect():
        none = not any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1 and (not none or r["score"] == 0)
    lower = langid.limits(docs, model)
    assert lower == {}  # too few rows to tell
    kept = langid.known_only(docs, model, lower)
    assert kept.columns == docs.columns
    scores = [(r["doc_id"], r["text"], r["score"]) for r in got.collect()]
    same_multiset([r["doc_id"] for r in kept.collect()], [i for i, t, x in scores if any(map(str.isalpha, t or "")) and (x >= langid.CHANCE or sum(map(str.isalpha, t)) < 20)])
    nothing = langid.train(empty)
    assert nothing[0] == [] and {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_predictions_against_plain_vectors(spark):
    """Every text's vector, prototype and cosine by plain loops over its trigrams."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 2500").limit(60).cache()
    coder = langid.Encoder()

    def vector(text):
        letters = " " + re.sub(r"\\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower())) + " "
        letters = re.sub(" +", " ", letters)
        out = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            if b != " ":
                out += np.roll(coder.letter(ord(a)), 2).astype(float) * np.roll(coder.letter(ord(b)), 1) * coder.letter(ord(c))
        return out / max(np.linalg.norm(out), 1e-9)

    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    sums = {}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            sums[lang] = sums.get(lang, 0) + vector(t)
    expected = {}
    for i, t, _ in rows:
        scores = {k: float(vector(t) @ v / np.linalg.norm(v)) for k, v in sorted(sums.items())}
        best = max(scores, key=scores.get)
        expected[i] = (best, scores[best])
    model = langid.train(docs.where(~langid.held_out()))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert set(got) == set(expected) and all(got[i][0] == expected[i][0] and got[i][1] == pytest.approx(max(0, expected[i][1]), abs=1e-4) for i in got)


def test_foreign_scripts_are_rejected_and_labelled_rows_stay(spark):
    rng = random.Random(6)
    docs = spark.read.parquet(os.path.join(os.path.dirname(SF.rstrip("/")), "sf0.01", "documents.parquet"))
    model = langid.train(docs)
    lower = langid.limits(docs, model)
    assert len(lower) >= 6 and all(langid.CHANCE <= x < 0.5 for x in lower.values())
    foreign = [(-i, " ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(15, 300)))) for i in range(1, 101)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(foreign, "doc_id long, text string"))
    kept = {r["doc_id"] for r in langid.known_only(table, model, lower).select("doc_id").collect()}
    gone = docs.where(~F.col("doc_id").isin(list(kept))).select("text", "doc_id").collect()
    assert not any(i < 0 for i in kept) and 0 < len(gone) <= 0.02 * docs.count()
    for r in gone:  # one word over and over, no prose
        w = WORD.findall(r["text"])
        assert max(Counter(w).values()) > 0.1 * len(w)


def test_vectors_are_sums_of_bound_trigrams():
    coder = langid.Encoder()
    (v,), _ = coder.vectors(["Ab, c"])
    at = lambda a, b, c: np.roll(coder.letter(ord(a)), 2) * np.roll(coder.letter(ord(b)), 1) * coder.letter(ord(c))
    plain = at(" ", "a", "b").astype(float) + at("a", "b", " ") + at(" ", "c", " ")
    assert np.allclose(v, plain / np.linalg.norm(plain), atol=1e-5)


# 5


def plain_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
        if not free:
            return out


def test_mix(spark, docs, empty):
    made = mixing.plan(docs, Scratch(spark, "t"), shards=5).rows.collect()
    again = mixing.plan(docs.repartition(7), Scratch(spark, "t"), shards=5).rows.collect()
    view = lambda rows: [(r["key"], r["size"], r["taken"], [tuple(d) for d in r["draws"]]) for r in rows]
    same_multiset(view(made), view(again))
    same_multiset([(r["key"], r["size"]) for r in made], [(i, len(WORD.findall(t or ""))) for i, t, *_ in edge_rows()])
    sizes, taken, target = Counter(), Counter(), {}
    for r in made:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        assert all(0 <= d["shard"] < 5 for d in r["draws"])
    expected = plain_targets(dict(sizes), (5, 2, 1), 3)
    assert all(target[s] == pytest.approx(expected[s]) for s in sizes)
    largest = {s: max(r["size"] for r in made if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert mixing.plan(empty, Scratch(spark, "t")).rows.collect() == []


def test_mix_of_tables_is_near_its_targets(spark):
    rows = queries.op5_weighted_mix(spark, os.path.join(os.path.dirname(SF.rstrip("/")), "sf0.01")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in rows)


def test_shards_of_a_mix_are_even(spark):
    draws = spark.createDataFrame([(f"s{i % 4}", i, 1) for i in range(103)], "source string, block int, pass int")
    got = mixing.deal(draws, Scratch(spark, "t"), 6, 1).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 103 and len(sizes) == 6 and max(sizes.values()) - min(sizes.values()) <= 2
    assert mixing.deal(draws, Scratch(spark, "t"), 1, 1).where("shard = 0").count() == 103
    assert all(n < 15 for n in Counter((r["source"], r["shard"]) for r in got).values())


def plain_mix(rows, weights, most, seed_hash):
    """How often each row is taken: whole passes, blocks in order, then single rows of the block where the target is met."""
    sizes, groups = Counter(), defaultdict(list)
    for n, (key, source, size) in enumerate(rows):
        sizes[source] += size
        groups[source].append((n, key, size))
    target = plain_targets(dict(sizes), weights, most)
    taken = [0] * len(rows)
    for source, own in groups.items():
        count = -(-len(own) // mixing.BLOCK_ROWS)
        passes = min(most, int(target[source] / sizes[source])) if sizes[source] else 0
        left = target[source] - passes * sizes[source]
        for n, *_ in own:
            taken[n] = passes
        for block in range(count if passes < most else 0):
            inside = sorted((x for x in own if seed_hash[x[1]] % count == block), key=lambda x: (seed_hash[x[1]], x[1] is not None, x[1] or 0, x[2]))
            words_ = sum(x[2] for x in inside)
            if left >= words_:
                for n, *_ in inside:
                    taken[n] += 1
            elif left > 0:
                fits, run = [], 0
                for x in inside:
                    run += x[2]
                    if run <= left:
                        fits.append(x)
                gap = left - sum(x[2] for x in fits)
                others = [x for x in inside if x not in fits]
                order = lambda x: (seed_hash[x[1]], x[1] is not None, x[1] or 0)
                fill, run = [], 0
                for x in sorted(others, key=lambda x: (x[2], *order(x))):
                    if run + x[2] / 2 <= gap:
                        fill.append(x)
                    run += x[2]
                one = sorted(others, key=lambda x: (abs(gap - x[2]), *order(x)))[:1]
                one = [x for x in one if abs(gap - x[2]) < gap]
                best = one if abs(gap - sum(x[2] for x in one)) < abs(gap - sum(x[2] for x in fill)) else fill
                for n, *_ in fits + best:
                    taken[n] += 1
            left -= words_
    return taken


def test_mix_against_a_plain_version(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    docs = docs.where("doc_id IS NULL OR doc_id <> 3")  # equal rows of one key may change places
    rows = [tuple(r) for r in docs.select("doc_id", "source", mixing.word_count(F.col("text")), "text").collect()]
    hashes = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit(11), "doc_id")).collect()}
    expected = plain_mix([r[:3] for r in rows], (5, 2, 1), 3, hashes)
    got = mixing.plan(docs, Scratch(spark, "t"), shards=5)
    same_multiset([(r["key"], r["size"], r["taken"]) for r in got.rows.collect()], [(r[0], r[2], n * r[2]) for r, n in zip(rows, expected)])
    mixed = mixing.mix(docs, Scratch(spark, "t"), shards=5)
    assert mixed.columns == docs.columns
    same_multiset([tuple(r) for r in mixed.select("doc_id", "source", "text").collect() if r["text"]], [(r[0], r[1], r[3]) for r, n in zip(rows, expected) for _ in range(n) if r[3]])


def test_written_mix(spark, docs, tmp_path):
    made = mixing.plan(docs, Scratch(spark, "t"), shards=5).rows.collect()
    mixing.write_mix(docs, str(tmp_path / "mix"), Scratch(spark, "t"), shards=5)
    got = spark.read.parquet(str(tmp_path / "mix"))
    assert set(got.columns) == set(docs.columns)
    same_multiset([(r["doc_id"], r["shard"]) for r in got.select("doc_id", "shard").collect()], [(r["key"], d["shard"]) for r in made for d in r["draws"]])
    whole = Counter(r["doc_id"] for r in got.select("doc_id").collect())
    assert whole == Counter(i for i in (r["key"] for r in made for _ in r["draws"]))
    ids = [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "mix" / "shard=1")).coalesce(1).select("doc_id").collect() if r["doc_id"]]
    assert ids != sorted(ids)


# 6


def plain_base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(triples)
    covered = {i + d for i, t in enumerate(triples) if seen[t] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty):
    got = quality.judge(docs, Scratch(spark, "t")).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    same_multiset([(r["doc_id"], *(r[c] for c in columns)) for r in got], [(i, *plain_base(t)) for i, t, *_ in edge_rows()])
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(empty, Scratch(spark, "t")).collect() == []


def test_a_frequent_long_word_counts(spark):
    rng = random.Random(9)
    long_ = "extraordinarily-long-word"
    texts = [" ".join(rng.choice([long_, long_, "of", "the"]) + str(rng.randint(0, 999)) * (rng.random() < 0.3) for _ in range(80)) for _ in range(60)]
    odd = " ".join(f"w{rng.randint(0, 99_999)}" for _ in range(80))
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate([*texts, odd])], "doc_id long, text string, lang string")
    common = quality.common_words(docs, Scratch(spark, "t")).first()
    counts = Counter(w for t in [*texts, odd] for w in WORD.findall(t))
    assert common["common"] == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:24]] and common["common"][0] == long_
    got = {r["doc_id"]: r for r in quality.judge(docs, Scratch(spark, "t"), max_class_distance=1.0).collect()}
    assert not got[60]["kept"] and not got[60]["base_failed"]
    assert all(r["kept"] for i, r in got.items() if i < 60 and not r["base_failed"]) and sum(r["kept"] for r in got.values()) > 30


def test_common_words_listed_or_looked_up_by_language(spark, docs, monkeypatch):
    """The words of all languages are listed once, if they are few; a word that is common elsewhere only does not count."""
    rows = [(1, "aa bb cc aa", "x"), (2, "dd aa ee ee", "y"), (3, "ff", None), (4, None, "z"), (5, "aa ff", "z")]
    mixed = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for table in (docs, mixed):
        own = quality.judge(table, Scratch(spark, "t"), min_words=1, min_reference_words=1)
        got, planned = own.collect(), []
        with monkeypatch.context() as m:
            m.setattr(quality, "LISTED_LANGUAGES", 0)
            measure = quality.measure
            m.setattr(quality, "measure", lambda *args: (planned.append(args[-1]), measure(*args))[1])
            same_multiset([tuple(r) for r in quality.judge(table, Scratch(spark, "t"), min_words=1, min_reference_words=1).collect()], [tuple(r) for r in got])
        assert planned == [None]


def test_divergence(spark):
    p, q = [3, 1, 0], [1, 1, 2]
    a, b = np.array(p) / 4, np.array(q) / 4
    m = (a + b) / 2
    truth = np.sqrt(sum(x * np.log2(x / y) for x, y in zip(np.r_[a, b], np.r_[m, m]) if x) / 2)
    row = spark.createDataFrame([(p, q, [0, 0, 0])], "p array<long>, q array<long>, z array<long>")
    got = row.select(quality.divergence(F.col("p"), F.col("q")), quality.divergence(F.col("p"), F.col("p")), quality.divergence(F.col("p"), F.col("z"))).first()
    assert got[0] == pytest.approx(truth) and got[1] == 0 and got[2] is None


def test_quality_of_labelled_rows(spark):
    got = quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark, "t")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in got)


# columns of any name


def unchanged(docs, got):
    assert got.columns == docs.columns
    assert got.where(" OR ".join(f"`{c}` IS NULL OR `{c}` <> '{CLASH}'" for c in CLASHES)).count() == 0 and not got.isEmpty()


def test_columns_of_any_name_come_back(spark, docs, tmp_path):
    items = spark.createDataFrame([(1, "no such words as these are in any of those texts", CLASH)], "item_id long, text string, key string")
    unchanged(docs, minhash.deduplicate(docs, Scratch(spark, "t")))
    unchanged(docs, mixing.mix(docs, Scratch(spark, "t"), shards=3))
    unchanged(docs, decontaminate.clean(docs, items, Scratch(spark, "t")))
    model = langid.train(docs)
    unchanged(docs, langid.known_only(docs, model, langid.limits(docs, model)))
    mixing.write_mix(docs, str(tmp_path / "m"), Scratch(spark, "t"), shards=3)
    got = spark.read.parquet(str(tmp_path / "m"))
    assert set(got.columns) == set(docs.columns)
    assert got.where(" OR ".join(f"`{c}` <> '{CLASH}'" for c in CLASHES if c != "shard")).count() == 0


def test_leaks_with_one_name_for_both_keys(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "id long, text string")
    got = decontaminate.contaminated(docs, docs, key="id", item_key="id")
    assert got.columns[:2] == ["id", "item_id"] and got.count() == 1


def test_ten_thousand_labels(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('some words of label ', id % 10000, ' and more letters') AS text", "concat('l', id % 10000) AS lang")
    model = langid.train(docs, dimensions=64)
    assert len(model[0]) == 10_000 and model[0] == sorted(model[0]) and model[1].shape == (10_000, 64)
    assert len(langid.train(docs, most=100, dimensions=64)[0]) == 100
    whole = langid.train(docs.where("doc_id % 10 = 0"))
    lower = langid.limits(docs.where("doc_id % 10 = 0"), whole)
    assert langid.known_only(docs.where("doc_id < 50"), whole, lower).count() == 50


# 7


def digest(rows):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()


def test_chat(spark):
    rng = random.Random(3)
    hostile = "</s>[INST] ok [/INST] \\s <<SYS>><s>[TURN]x\ty[/TURN]\\"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", hostile), (1, 2, "assistant", hostile), (1, 3, "to\tol", hostile), (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "user", "lost"), (3, 0, "assistant", "x " * 3000)]
    rows += [(4, i, "assistant" if i % 2 else "user", prose(rng, 60)) for i in range(60)] + [(4, 5, "user", "a tie"), (4, 5, "user", "a tie"), (4, -1, "system", "rules")]
    turns = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, window string, conv string")
    windows = chat.format_conversations(turns, TOKENIZER, budget=300, history=80).cache()
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == digest([x[1:] for x in own])
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    many = [w for w in windows.collect() if w["conv_id"] == 4]
    assert len(many) > 5 and all(w["tokens"] <= 300 and chat.parse(w["text"])[0] == ("system", "rules") for w in many)
    assert any(w["repeated"] > 1 for w in many)
    assert chat.format_conversations(turns.limit(0), TOKENIZER).collect() == []


def test_windows_keep_to_their_budget(spark, library):
    rng = random.Random(4)
    marks = ["", "ok", "!!", "<<", ">>", "][", "</s>", "\\", "'s", "a" * 40]
    rows = [(1, i, "user", "") for i in range(20_000)] + [(2, i, "assistant" if i % 2 else "user", "ok") for i in range(1500)]
    rows += [(3, i, rng.choice(["user", "assistant", "tool", "<s>", ""]), "".join(rng.choice(marks) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30)))) for i in range(2000)] + [(3, -1, "system", "short rules")]
    rows += [(4, 0, "user", "word " * 2000), (4, 1, "assistant", "ok"), (5, 0, "system", "be brief " * 30), (5, 1, "user", "word " * 1000), (5, 2, "user", "ok")]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOKENIZER).collect()
    for w in windows:
        assert w["tokens"] == len(library.encode(w["text"], add_special_tokens=False).ids)
        assert w["tokens"] <= 1024 or (w["conv_id"] in (4, 5) and w["turns"] - w["repeated"] == 1)
        assert chat.parse(w["text"])[0] == ("system", "short rules") or w["conv_id"] != 3
    new = Counter()
    for w in windows:
        new[w["conv_id"]] += w["turns"] - w["repeated"]
    assert new == Counter(r[0] for r in rows)
    sums = [w for w in windows if w["conv_id"] == 1]
    assert len(sums) > 50 and all(w["tokens"] > 1000 for w in sums[:-1])


# 8


def plain_repeats(rows, window):
    counts, texts = Counter(), []
    for i, t in rows:
        w = WORD.findall(t or "")
        texts.append((i, w))
        counts.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    expected = []
    for i, w in texts:
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - window + 1):
            if counts[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return expected


def test_repeats(spark, docs, empty):
    got = substrings.remove_repeats(docs, Scratch(spark, "t"), window=35).collect()
    expected = plain_repeats([r[:2] for r in edge_rows()], 35)
    same_multiset([tuple(r) for r in got], expected)
    assert sum(e[2] > 0 for e in expected) >= 7
    assert substrings.remove_repeats(empty, Scratch(spark, "t")).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, Scratch(spark, "t"), window=5, edge=6)


def branching_rows(seed):
    """Texts cut from few passages with changes, so that paths branch, end, cross and repeat in one text."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(20, 120))] for _ in range(5)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randint(5, 90)]
            if rng.random() < 0.5:
                w.append(rng.choice("xyz"))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows + [(i, rows[0][1]) for i in range(200, 230)] + [(300, "a " * 500), (301, "a " * 77), (302, "a b " * 60), (303, " ".join(passages[0]))]


@pytest.mark.parametrize(("window", "edge", "bits"), [(35, 12, 64), (35, 8, 64), (20, 20, 64), (12, 3, 64), (35, 12, 9), (20, 5, 6)])
def test_repeats_with_branches_and_colliding_hashes(spark, window, edge, bits):
    rows = branching_rows(window + edge)
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), Scratch(spark, "t"), window=window, edge=edge, bits=bits).collect()
    expected = plain_repeats(rows, window)
    same_multiset([tuple(r) for r in got], expected)
    assert 0.1 < sum(e[2] for e in expected) / sum(e[1] for e in expected) < 0.999


# 9


def plain_distance(p, t):
    row = list(range(len(p) + 1))
    best = (len(p), 0)
    for j, x in enumerate(t):
        new = [0]
        for i, y in enumerate(p):
            new.append(min(row[i] + (x != y), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, (row[-1], j + 1), key=lambda b: b[0])
    return best


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(600):
        p, t = [rng.randint(0, 3) for _ in range(rng.randint(1, 80))], [rng.randint(0, 3) for _ in range(rng.randint(0, 90))]
        assert decontaminate.best_match(p, t) == plain_distance(p, t)


def plain_leaks(rows, items, percent=20, min_words=8):
    """Distance of every item to every text, by dynamic programming over normalised words."""
    cut = lambda t: [x for x in re.split(r"[^a-z0-9\x80-\U0010ffff]+", decontaminate.normal(t or "")) if x]
    out = []
    for i, t in rows:
        for j, p in items:
            p, w = cut(p), cut(t)
            e = len(p) * percent // 100 if len(p) >= min_words else 0
            if p and t is not None:
                distance, _ = plain_distance(p, w)
                if distance <= e:
                    out.append((i, j, distance, len(p)))
    return out


def test_leaks(spark, docs, empty):
    rng = random.Random(8)
    items = [(1, prose(rng, 30)), (2, prose(rng, 15)), (3, "too short"), (4, None), (5, ""), (1, prose(rng, 20)), (6, "same same same same same same same same same"), (7, "Just four Words, here"), (8, prose(rng, 9))]
    w = items[0][1].split()
    near = w[:5] + ["other"] + w[6:12] + w[13:20] + ["added"] + w[20:]
    rows = [(1, "before " + items[0][1].upper().replace(".", "!") + " after"), (2, " ".join(near)), (3, " ".join(w[:20])), (4, prose(rng, 200)), (5, None), (6, items[1][1]), (6, items[1][1]), (None, items[5][1]), (7, "")]
    rows += [(8, "it is too, short."), (9, "or just four words here"), (10, "same " * 300), (11, "just four other words here"), (12, items[1][1] + " x " + " ".join(items[1][1].split()[1:]))]
    for i in range(20, 60):  # items with words changed, added and left out, within and beyond the budget
        x = rng.choice([items[0][1], items[1][1], items[5][1], items[8][1]]).split()
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(x))
            x[k : k + 1] = rng.choice([[], [x[k], "more"], ["changed"]])
        rows.append((i, prose(rng, rng.randint(0, 40)) + " " + " ".join(x) + " " + prose(rng, rng.randint(0, 40))))
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(table, bench).collect()
    expected = plain_leaks(rows, items)
    same_multiset([(r["doc_id"], r["item_id"], r["distance"], r["item_words"]) for r in got], expected)
    assert {(1, 1, 0, 30), (2, 1, 3, 30), (6, 2, 0, 15), (None, 1, 0, 20), (8, 3, 0, 2), (9, 7, 0, 4)} <= set(expected) and len(expected) > 25
    for r in got:
        assert 0 <= r["first_word"] < r["end_word"] and abs(r["end_word"] - r["first_word"] - r["item_words"]) <= r["distance"]
    kept = decontaminate.clean(table, bench, Scratch(spark, "t"))
    assert kept.columns == table.columns
    bad = {i for i, _, _, n in expected if n >= 4}
    same_multiset([r["doc_id"] for r in kept.collect()], [i for i, _ in rows if i not in bad])
    assert {3, 4, 5, 7, 8, 11} & bad == set() and 9 in bad
    assert decontaminate.contaminated(empty, bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.clean(docs, bench.limit(0), Scratch(spark, "t")).count() == len(edge_rows()) and decontaminate.clean(empty, bench, Scratch(spark, "t")).count() == 0


def test_one_word_over_and_over_takes_linear_time():
    index = decontaminate.Items(["i"], ["a " * 16], 20, 8)
    began = time.time()
    assert index.find(["a " * 40_000]) == [(0, 0, 0, 0, 16)]
    assert time.time() - began < 2


def test_item_blocks_cover_all_items(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, 12)) for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, 20, 8, limit=700))
    assert len(blocks) > 3 and sorted(i for b in blocks for i in b.index().ids) == list(range(50))
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (8, "item_id", "text", 1500))
    table = spark.createDataFrame([(i, t) for i, t in items if i % 2] + [(99, "clean")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.clean(table, bench, Scratch(spark, "t")).collect()] == [99]
    same_multiset([tuple(r) for r in decontaminate.contaminated(table, bench).select("doc_id", "item_id").collect()], [(i, i) for i in range(1, 50, 2)])


# 10


def test_packs(spark, docs, empty, library, monkeypatch):
    scratch = Scratch(spark, "t")
    got = packing.write_and_read(docs, scratch, TOKENIZER, packing.vocabulary(TOKENIZER), 2).collect()
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:])) and starts[0][0] == 0
    ids = [r[2] for r in starts]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    expected = []
    for i, t, *_ in edge_rows():
        x = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((i, len(x), zlib.crc32(x.tobytes())))
    same_multiset([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], expected)
    assert packing.write_and_read(empty, Scratch(spark, "t"), TOKENIZER, 49408, 2).collect() == []


def test_spans_of_packs(spark, docs, library, monkeypatch):
    """Any ids of the corpus from the blocks that hold them, against all ids in a row; 17 bits, so that they are packed."""
    path = Scratch(spark, "t").path("packs")
    packs = packing.write(docs.where("doc_id IS NOT NULL").repartition(3), path, TOKENIZER, 100_000, 2)
    rows = sorted(((i, t or "") for i, t, *_ in edge_rows() if i is not None), key=lambda r: r[0])
    flat = np.concatenate([library.encode(t, add_special_tokens=False).ids + [2] for _, t in rows])
    monkeypatch.setattr(packing, "PACK_IDS", 50_000)
    n = len(flat)
    spans = [("a", 0, 5), ("b", 4094, 4100), ("c", n - 3, n + 10), ("d", 10, 10), ("e", None, 4), ("f", 100, n), ("g", n, n + 5), ("h", 70_000, 70_001)]
    got = {r["name"]: r["ids"] for r in packing.read_spans(packs, spark.createDataFrame(spans, "name string, start long, end long")).collect()}
    assert got == {k: [] if a is None else flat[a:b].tolist() for k, a, b in spans}
    assert packing.read_spans(packs.limit(0), spark.createDataFrame(spans[:1], "name string, start long, end long")).first()["ids"] == []


@pytest.mark.parametrize("n_ids", [2, 100, 50257, 65536, 200_000])
def test_pack_bytes(n_ids):
    rng = np.random.default_rng(n_ids)
    ids, lengths = rng.integers(0, n_ids, 10_000).astype(np.uint32), np.array([0, 4000, 6000])
    raw = packing.pack(ids, lengths, packing.width(n_ids))
    one = packing.Pack(raw)
    assert (one.ids() == ids).all() and (one.ids(4090, 4200) == ids[4090:4200]).all() and one.lengths.tolist() == lengths.tolist()
    assert len(raw) < 10_000 * packing.width(n_ids) / 8 + 200


# all


def test_pipeline(spark, library):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, kept = Scratch(spark, "t"), []
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = scratch.save(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert 0.98 * docs.count() <= len(kept[0]) and len(kept[1]) < len(kept[0]) and kept[2] < kept[1] and kept[3] <= kept[2]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r["doc_id"] in kept[0]]
    assert kept[1] == {r[0] for r, c in zip(rows, components_of(rows, 5, 80)) if r[0] == c}
    leaked = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert kept[2] == kept[1] - leaked and leaked & kept[1]
    # the mix against plain quotas over what the stage before it kept
    sized = [tuple(r) for r in docs.select("doc_id", "source", mixing.word_count(F.col("text"))).collect() if r["doc_id"] in kept[2]]
    hashes = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit(11), "doc_id")).collect()}
    expected = Counter({r[0]: n for r, n in zip(sized, plain_mix(sized, (5, 2, 1), 3, hashes)) if n})
    mixed = sorted(tuple(r) for r in now.select("doc_id", "text").collect())
    assert Counter(i for i, _ in mixed) == expected
    # the ids against the library, in the order of keys
    start, packed = 0, []
    for i, text in mixed:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        packed.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == packed


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    rows = docs.select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    nothing = tmp_path / "nothing"
    rows.limit(0).write.parquet(str(nothing / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(nothing / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(nothing)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, spark, duck):
    from compare import rows

    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())


def test_languages_and_limits_are_learned_from_all_rows(spark, monkeypatch):
    """3,000 rows of one label: prototype and limits come from every one of them."""
    texts = [f"{'abcdefghij'[i % 10] * 3} wort {'klmnopqrst'[i // 10 % 10] * 2} zeile {'uvwxyzabcd'[i // 100 % 10]} und noch mehr davon" for i in range(3000)]
    docs = spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    names, table = langid.train(docs)
    whole = langid.encoder(langid.DIMENSIONS, langid.SEED).vectors(texts)[0].astype(np.float64).sum(axis=0)
    assert names == ["de"] and np.allclose(table[0], whole / np.linalg.norm(whole), atol=1e-6)
    seen, plain = [], langid.predict
    monkeypatch.setattr(langid, "predict", lambda rows, *a, **how: seen.append(rows.count()) or plain(rows, *a, **how))
    langid.limits(docs, (names, table))
    assert seen == [3000]
