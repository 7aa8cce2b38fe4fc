"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

SuperMinHash gives every shingle one random permutation of the slots: at its
rank j it offers the value j plus a random fraction to the slot at place j. A
slot keeps the least offer. Offers of rank j cannot replace those of a lower
rank, so a text is done as soon as every slot has one of a lower rank than the
next, after one or two ranks for texts with many shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm import words
from fathomline.llm.components import connected, relabel
from fathomline.llm.skew import join_counted
from fathomline.llm.store import Scratch

_U = np.uint64
#: 32 bands of 5 slots: of pairs at a similarity of 0.8, 3 in a million share no band.
BANDS, ROWS = 32, 5
#: Buckets of up to so many classes list their pairs.
SMALL_BUCKET = 16
#: Members of a large group are compared in blocks of about so many sets, and of about so many shingles.
BLOCK_SETS, BLOCK_ITEMS = 128, 1 << 18
#: Members of each size in a large group that others meet first; others that one task compares with one set; classes of sizes in the ratio that is similar.
CENTERS, STAR, CUTS = 2, 4096, 4
#: Rank from which permutations are kept whole rather than traced back.
TRACED = 4


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text of one block, of which a short text is one."""
    w = words.cut(texts, lower=True)
    long = w.windows(size)
    out = []
    for i in range(len(texts)):
        first, last = w.first[i], w.first[i + 1]
        n = last - first
        if n >= size:
            out.append(np.unique(long[first : last - size + 1]))
        elif n:
            short = words.mix(np.array([n], np.uint64))
            for h in w.hash[first:last]:
                short = words.mix(short ^ h)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash of each set, a row of slots; that of an empty set means nothing."""
    best = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    item = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    chosen: list[np.ndarray] = []  # at each rank so far, the place that each item swapped with
    whole: np.ndarray | None = None
    for rank in range(slots):
        if not len(item):
            break
        draw = words.mix(item + _U(rank * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = (rank + (((draw & _U(0xFFFFFFFF)) * _U(slots - rank)) >> _U(32)).astype(np.int64)).astype(np.int16)
        if whole is None and rank == TRACED:
            whole = np.tile(np.arange(slots, dtype=np.int16), (len(item), 1))
            rows = np.arange(len(item))
            for j, k in enumerate(chosen):
                whole[rows, k] = whole[:, j]
        if whole is None:
            slot = place.copy()
            for j in range(rank - 1, -1, -1):  # what stands at that place came from place j, if rank j swapped it
                slot[slot == chosen[j]] = j
            chosen.append(place)
        else:
            rows = np.arange(len(item))
            slot = whole[rows, place]
            whole[rows, place] = whole[:, rank]
        offer = _U(rank << 32) | (draw >> _U(32))
        np.minimum.at(best, owner * slots + slot, offer)
        open_ = best.reshape(-1, slots).max(axis=1) >= _U((rank + 1) << 32)
        keep = open_[owner]
        if not keep.all():
            item, owner = item[keep], owner[keep]
            chosen = [c[keep] for c in chosen]
            whole = whole[keep] if whole is not None else None
    return best.reshape(-1, slots)


def bands(signature: np.ndarray, count: int = BANDS) -> np.ndarray:
    """Hash of each band of each signature, as signed integers."""
    parts = signature.reshape(len(signature), count, -1)
    h = np.broadcast_to(words.mix(np.arange(count, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        h = words.mix(h ^ parts[:, :, r])
    return h.view(np.int64)


def set_keys(items: np.ndarray) -> tuple[int, int]:
    """Two sums over a set, signed; together with its size they tell whether two sets are equal."""
    sums = np.array([words.mix(items ^ _U(seed)).sum(dtype=np.uint64) for seed in (0x5BD1E995, 0x27D4EB2F)], np.uint64)
    one, two = sums.view(np.int64).tolist()
    return one, two


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.blocks(batch["text"]):
                sets = shingle_sets(batch["text"][a:b], size)
                hashes = bands(signatures(sets))
                n = np.array([len(s) for s in sets], np.int64)
                keys = np.array([set_keys(s) for s in sets], np.int64).reshape(-1, 2)
                columns = [batch["doc_id"][a:b], batch["h"][a:b], pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, BANDS), pa.int32()), pa.array(hashes.reshape(-1))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "k1", "k2", "bands"])

    return run


def _sets(size: int):
    """Sets of the classes that are asked for with each row (a row of a repeated key may have the text of one of them, or of none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.blocks(batch["text"]):
                ids, found = [], []
                for asked, items in zip(batch["asked"][a:b].to_pylist(), shingle_sets(batch["text"][a:b], size)):
                    own = (len(items), *set_keys(items))
                    for one in asked:
                        if (one["n"], one["k1"], one["k2"]) == own:
                            ids.append(one["cid"])
                            found.append(items)
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                flat = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["cid", "items"])

    return run


def _agree(percent: int):
    """Of pairs with both sets, those with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("x", "y"):
                column = batch[name]
                sides.append((np.asarray(column.offsets), np.asarray(column.values)))
            (xo, x), (yo, y) = sides
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[xo[i] : xo[i + 1]].view(np.uint64), y[yo[i] : yo[i + 1]].view(np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int(np.count_nonzero(q[at] == p))
                keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))

    return run


def _block_links(percent: int):
    """Links between the sets of two blocks, without shingles that only one set has, as a forest: the least class that each one leads to."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        table = table.take(pa.array(order))
        ids, size, m = table["cid"].to_numpy(), table["n"].to_numpy().astype(np.int64), int((side == 0).sum())
        lists = table["items"].combine_chunks()
        flat = np.asarray(lists.flatten())
        owner = np.repeat(np.arange(len(ids)), np.asarray(pa.compute.list_value_length(lists)).astype(np.int64))
        _, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
        keep = seen[inverse] > 1
        owner, column = owner[keep], np.unique(inverse[keep], return_inverse=True)[1]
        both = np.zeros((m, len(ids) - m), np.float32)
        for low in range(0, int(column.max(initial=-1)) + 1, 8192):
            part = (column >= low) & (column < low + 8192)
            dense = np.zeros((len(ids), 8192), np.float32)
            dense[owner[part], column[part] - low] = 1
            both += dense[:m] @ dense[m:].T
        both = both.astype(np.int64)
        linked = 100 * both >= percent * (size[:m, None] + size[None, m:] - both)
        left, right = ids[:m].copy(), ids[m:].copy()
        far = np.iinfo(np.int64).max
        while linked.any():
            low = np.minimum(left, np.where(linked, right[None, :], far).min(axis=1))
            high = np.minimum(right, np.where(linked, low[:, None], far).min(axis=0))
            if (low == left).all() and (high == right).all():
                break
            left, right = low, high
        root = np.concatenate([left, right])
        return pa.table({"a": root, "b": ids}).filter(pa.array(root != ids))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those that are similar on their full sets."""
    met = pairs.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a")
    met = met.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(_agree(percent), "a long, b long")


def _verify_stars(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """As _verify, for pairs (a, b, rows) where an a has up to ``rows`` others: its set is there once for each STAR of them."""
    salts = F.ceil(F.col("rows") / STAR).cast("int")
    center = stars.groupBy("a").agg(F.max(salts).alias("salts"))
    center = center.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    center = center.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a")
    placed = stars.withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int"))
    met = placed.join(center, ["a", "salt"]).join(sets.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(_agree(percent), "a long, b long")


def _open(members: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Members (grp, cid, ...) of groups that links do not connect as a whole, with main: whether in the largest component of the group."""
    now = scratch.save(relabel(members, connected(links, scratch, f"{name}-found"), "cid", "comp"), f"{name}-members")
    parts = now.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("size"))
    parts = parts.groupBy("grp").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "comp"))["comp"].alias("largest"), F.sum("size").alias("_rows"))
    parts = scratch.save(parts.where("parts > 1").select("grp", "largest", "_rows"), f"{name}-parts")
    left = join_counted(now, parts, ["grp"], now.count())
    return scratch.save(left.withColumn("main", F.col("comp") == F.col("largest")).drop("largest"), f"{name}-open")


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Members (grp, cid, n, s, main): a row for each pair of blocks that a member is needed in, the first of members outside the main component.

    n is a set's size and s that of its part that other sets have too. A group is cut by size, so that sets which
    could be similar are in near classes, and by hash into blocks. A member is left out of pairs with a class
    in which no set could be similar to it, as no intersection is larger than s.
    """
    known = members.withColumn("class", _class("n", percent))
    outside = F.when(~F.col("main"), F.lit(1)).otherwise(0)

    def blocks(weight):
        return F.ceil(F.greatest(F.sum(weight) / BLOCK_SETS, F.sum(weight * F.col("s")) / BLOCK_ITEMS)).cast("int")

    classes = known.groupBy("grp", "class").agg(blocks(F.lit(1)).alias("all"), blocks(outside).alias("out"), F.min("n").alias("low"), F.max("s").alias("most"), F.count(F.lit(1)).alias("size"))
    # as many classes as the logarithm of a set's size has steps
    groups = classes.groupBy("grp").agg(F.collect_list(F.struct("class", "all", "out", "low", "most")).alias("classes"), F.sum("size").alias("_rows"))
    known = join_counted(known, groups, ["grp"], members.count())
    mine = F.filter("classes", lambda c: c["class"] == F.col("class"))[0]
    known = known.withColumn("all", mine["all"]).withColumn("out", mine["out"])
    could = lambda c: (F.abs(c["class"] - F.col("class")) <= CUTS + 1) & (F.least("s", c["most"]) * (100 + percent) >= (F.col("n") + c["low"]) * percent)
    near = F.filter("classes", could)

    def pairs(make, number):
        return F.flatten(F.transform(near, lambda c: F.transform(F.when(c[number] > 0, F.sequence(F.lit(0), c[number] - 1)).otherwise(F.array().cast("array<int>")), lambda j: make(c["class"], j))))

    cls, own = F.col("class"), lambda number: F.pmod(F.xxhash64("cid"), F.col(number)).cast("int")
    first = pairs(lambda c, j: F.struct(cls.alias("c1"), own("out").alias("b1"), c.alias("c2"), j.alias("b2"), F.lit(0).alias("side")), "all")
    second = pairs(lambda c, j: F.struct(c.alias("c1"), j.alias("b1"), cls.alias("c2"), own("all").alias("b2"), F.lit(1).alias("side")), "out")
    return known.select("grp", "cid", "n", F.explode(F.when(F.col("main"), second).otherwise(F.concat(first, second))).alias("p")).select("grp", "cid", "n", "p.*")


def _in_large_buckets(large: DataFrame, stars: DataFrame, links: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links among classes that share large buckets, beyond those given, which connect the same classes as all of their links would.

    Classes that buckets connect form a group. Members of a group's one component need no more comparisons.
    Of each other one the shingles that no other member has are counted: what is left bounds every intersection.
    Then open members meet those with the least of their own, CENTERS of each class of sizes, and what that
    leaves open meets all other members that it could be similar to, block by block.
    """
    group = connected(stars.select("a", "b"), scratch, "groups")
    members = scratch.save(relabel(large.select("cid", "n").distinct(), group, "cid", "grp"), "members")
    left = _open(members, links, scratch, "first")
    if left.isEmpty():
        return links
    left = left.drop("comp", "main", "_rows")
    items = left.join(sets, "cid").select("grp", "cid", F.explode("items").alias("item"))
    alone = items.groupBy("grp", "item").agg(F.count(F.lit(1)).alias("times"), F.min("cid").alias("cid")).where("times = 1")
    alone = scratch.save(alone.groupBy("cid").agg(F.collect_list("item").alias("own")), "alone")
    left = left.join(alone, "cid", "left").withColumn("s", F.col("n") - F.coalesce(F.size("own"), F.lit(0)))
    # a set whose shared part is too small for its own size is similar to no other
    left = scratch.save(left.where(F.col("s") * 100 >= F.col("n") * percent), "sharing")
    shared = left.join(sets, "cid").select("cid", F.when(F.col("own").isNull(), F.col("items")).otherwise(F.array_except("items", "own")).alias("items"))
    shared = scratch.save(shared, "shared")
    left = left.drop("own")
    rank = F.row_number().over(Window.partitionBy("grp", _class("n", percent)).orderBy(F.desc(F.col("s") / F.col("n")), "cid"))
    center = left.select("grp", F.col("cid").alias("a"), F.col("n").alias("n2"), F.col("s").alias("s2"), rank.alias("rank")).where(F.col("rank") <= CENTERS)
    sizes = left.groupBy("grp").agg(F.count(F.lit(1)).alias("_rows"))
    center = center.join(sizes, "grp").groupBy("grp").agg(F.collect_list(F.struct("a", "n2", "s2", F.col("_rows").alias("rows"))).alias("centers"), F.max("_rows").alias("_rows"))
    total = left.count()
    could = lambda c: (c["a"] != F.col("cid")) & (F.least("s", c["s2"]) * (100 + percent) >= (F.col("n") + c["n2"]) * percent)
    met = join_counted(left, scratch.save(center, "centers"), ["grp"], total).select(F.col("cid").alias("b"), F.explode(F.filter("centers", could)).alias("c"))
    met = met.select(F.col("c.a").alias("a"), "b", F.col("c.rows").alias("rows"))
    links = links.unionByName(scratch.save(_verify_stars(met.select("a", "b", "rows"), sets, percent), "center-links"))
    left = _open(left, links, scratch, "second")
    placed = _block_pairs(left, percent).join(shared, "cid")
    forest = placed.groupBy("grp", "c1", "b1", "c2", "b2").applyInArrow(_block_links(percent), "a long, b long")
    return links.unionByName(scratch.save(forest, "forest"))


def _class(n, percent: int):
    """Class of a set's size: CUTS classes for the ratio of sizes at which sets could just be similar."""
    return F.floor(F.log(F.col(n).cast("double")) / (math.log(100 / percent) / CUTS)).cast("int")


def _alike(n, m, percent: int):
    """Whether sets of these sizes could be similar."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _found(docs: DataFrame, scratch: Scratch, key: str, text: str, size: int, percent: int) -> DataFrame:
    """A row (doc_id, h, n, cid, component) per row of docs: hash of its text, class of its set (null if it has no links) and the least class that links lead to, with the least key (component)."""
    known = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = known.withColumn("h", F.xxhash64("text")).select("doc_id", "h", "text")
    signed = scratch.save(signed.mapInArrow(_sign(size), "doc_id long, h long, n long, k1 long, k2 long, bands array<long>"), "signed")
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n")
    classes = classes.agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("_rows"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    entries = classes.select("cid", "n", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min(F.struct("cid", "n")).alias("low"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = scratch.save(shared.withColumn("_rows", F.col("rows")), "buckets")
    entries = scratch.save(join_counted(entries, shared, ["band"], classes.count() * BANDS), "entries")

    needed = entries.select("cid").distinct().join(classes, "cid")
    asked = needed.groupBy("rep").agg(F.collect_list(F.struct("cid", "n", "k1", "k2")).alias("asked"))
    texts = known.join(asked, F.col("doc_id") == F.col("rep")).select("text", "asked")
    sets = scratch.save(texts.mapInArrow(_sets(size), "cid long, items array<long>").dropDuplicates(["cid"]), "sets")

    small = entries.where(F.col("rows") <= SMALL_BUCKET)
    other = small.select("band", F.col("cid").alias("b"), F.col("n").alias("n2"))
    pairs = small.select("band", F.col("cid").alias("a"), "n").join(other, "band").where((F.col("a") < F.col("b")) & _alike("n", "n2", percent))
    links = scratch.save(_verify(pairs.select("a", "b").distinct(), sets, percent), "links")
    large = entries.where(F.col("rows") > SMALL_BUCKET)
    if not large.isEmpty():
        stars = large.where("low.cid <> cid").groupBy(F.col("low.cid").alias("a"), F.col("cid").alias("b"))
        stars = scratch.save(stars.agg(F.max("rows").alias("rows"), F.first("n").alias("n"), F.first("low.n").alias("n2")), "stars")
        links = links.unionByName(scratch.save(_verify_stars(stars.where(_alike("n", "n2", percent)).select("a", "b", "rows"), sets, percent), "star-links"))
        links = _in_large_buckets(large, stars, links, sets, scratch, percent)
    found = connected(links, scratch, "found")

    # classes with links only: the least key of each component
    linked = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    linked = scratch.save(linked.join(classes.select(F.col("cid").alias("node"), "rep"), "node"), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("_rows"))
    linked = join_counted(linked, scratch.save(least, "least"), ["root"], linked.count()).select(F.col("node").alias("cid"), "root", "component")
    named = classes.select("k1", "k2", "n", "cid", "rep", "_rows").join(linked, "cid", "left")
    named = scratch.save(named.select("k1", "k2", "n", "_rows", F.coalesce("root", "cid").alias("cid"), F.coalesce("component", "rep").alias("component")), "named")
    able = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    rows = signed.drop("bands")
    out = join_counted(rows.where(able), named, ["k1", "k2", "n"], signed.count()).select("doc_id", "h", "n", "cid", "component")
    rest = rows.where(~able).select("doc_id", "h", "n", F.lit(None).cast("long").alias("cid"), F.col("doc_id").alias("component"))
    out = scratch.save(out.unionByName(rest), "components")
    scratch.drop_all_but("components")
    return out


def near_duplicates(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets
    of distinct shingles of ``size`` words (a-z for A-Z); component_id is the least
    key that links lead to. Null, empty and blank texts have no shingles and no
    links. A row with a null key has no links: its component_id is null and it is
    kept. Rows are told apart by their texts, so rows that repeat a key each have the
    component of their own text. An empty table gives an empty result; other columns
    are not read.

    Equal sets form a class. Candidates are classes that share a band; what links them
    is verified on full sets. Buckets of up to SMALL_BUCKET classes list their pairs,
    at most SMALL_BUCKET for each class and band. In larger ones each class meets the
    bucket's first class, and then only what could still change the components:
    see _in_large_buckets. No pairs of a large bucket are listed.
    """
    out = _found(docs, scratch, key, text, size, percent)
    kept = F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the least key, with all its columns.

    Of a group's rows with that key the one whose text has the least hash stays, and
    of equal ones any. Rows with a null key and texts without words stay. Rows that
    repeat a key belong to the groups of their own texts, so no text goes that has no
    other copy. Rows that go are found by key and hash of the text.
    """
    found = _found(docs, scratch, key, text, size, percent)
    grouped = found.where("cid IS NOT NULL")
    first = grouped.groupBy("cid").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    first = scratch.save(first, "first-rows")
    met = join_counted(grouped, first, ["cid"], found.count())
    same = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.h") == F.col("h"))
    met = scratch.save(met.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("times"), F.max(same).alias("stays")), "decided")
    # each row goes as one struct, so that no name of its columns matters
    out = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    on = lambda t: (out["key"] == t["doc_id"]) & (out["hash"] == t["h"])
    gone = met.where("NOT stays OR times > 1").select("doc_id", "h")
    again = scratch.save(met.where("stays AND times > 1").select("doc_id", "h"), "again")
    kept = out.join(gone, on(gone), "left_anti")
    if not again.isEmpty():
        # equal rows of one key: partial aggregation leaves one of each in every task before they meet
        copies = out.join(again, on(again), "left_semi").dropDuplicates(["key", "hash"])
        kept = kept.unionByName(copies)
    return kept.select("row.*")
