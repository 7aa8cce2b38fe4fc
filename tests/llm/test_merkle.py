"""The manifest against a plain version, node by node and leaf by leaf."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fathomline.llm import merkle
from fathomline.llm.store import Scratch


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        low = out[-1]
        out.append([h(*low[i : i + 3]) for i in range(0, len(low), 3)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        first = i - i % 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def plain(rows):
    """rows of doc_id, text, lang, source, n_chars."""
    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        claim = text
        if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0:
            claim = text.replace("\n", "")
        groups[source].append((doc is not None, doc or 0, plain_leaf(doc, source, lang, n, text), plain_leaf(doc, source, lang, n, claim)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])]) for s in order}
    over = climb([trees[s][-1][0] for s in order])
    root, out = over[-1][0], []
    for j, s in enumerate(order):
        for i, (known, doc, own, claim) in enumerate(sorted(groups[s])):
            way, folded = path(trees[s], i) + path(over, j), claim
            for before, after in way:
                folded = h(before, folded, after)
            out.append((doc if known else None, own, trees[s][-1][0], root, h(*(b + a for b, a in way)), folded, folded == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, docs):
    got = merkle.check(docs, Scratch(spark, "m"), {"text": merkle.without_newlines()})
    assert got.columns == COLUMNS
    expected = plain([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    return expected


def test_manifest_of_odd_rows(spark, docs):
    with_chars = docs.withColumn("n_chars", F.length("text").cast("long"))
    clashing = with_chars.withColumns({c: F.lit("x") for c in ("claim", "digest", "items", "lo", "hi", "rank", "place", "path", "leaf", "root", "bucket", "group", "all", "_part", "_piece")})
    rows = check(spark, clashing)
    assert any(not r[-1] for r in rows) and any(r[-1] for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 243, 244, 800])
def test_manifest_of_one_large_group(spark, n):
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('line', char(10), id) AS text", "'xx' AS lang", "if(id < 3, null, 'big') AS source", "7L AS n_chars")
    check(spark, docs.repartition(5))


def test_manifest_of_many_groups(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "'a' AS text", "string(null) AS lang", "concat('s', id % 400) AS source", "1L AS n_chars")
    check(spark, docs)


def test_manifest_of_nothing(spark, empty):
    got = merkle.check(empty.withColumn("n_chars", F.lit(1)), Scratch(spark, "m"))
    assert got.columns == COLUMNS and got.count() == 0


def test_nodes_cover_their_intervals(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "string(id) AS text", "'xx' AS lang", "'one' AS source", "1L AS n_chars")
    made = merkle.build(docs, Scratch(spark, "m"))
    tree = climb([plain_leaf(i, "one", "xx", 1, i) for i in range(1000)])
    got = {(r["level"], r["lo"], r["hi"]): r["digest"] for r in made.trees.nodes().collect()}
    expected = {(t, i * 3**t, min(1000, (i + 1) * 3**t)): d for t, level in enumerate(tree) for i, d in enumerate(level) if t}
    assert got == expected and made.root == tree[-1][0]


def test_a_proof_fails_for_any_other_leaf(spark):
    nodes = [(i, i + 1, h(str(i))) for i in range(100)]
    ways = merkle.paths(nodes, merkle.height(100))
    root = climb([x[2] for x in nodes])[-1][0]
    assert all(merkle.fold(x[2], w) == root for x, w in zip(nodes, ways))
    assert merkle.fold(nodes[0][2], ways[1]) != root
