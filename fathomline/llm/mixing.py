"""Mixing sources to target weights, with DataFrame functions only.

Each source's rows are cut into blocks by a hash of their key. A source takes
whole passes over its blocks and one partial pass, so that its words meet its
target; the last block of the partial pass is cut between rows. The draws of all
sources are then dealt to output shards by a splitting tree: at each node the
draws are put in a random order and halved, which splits every source's quota as
a multivariate hypergeometric draw while quotas stay exact. Blocks of one pass
are disjoint, and rows of a shard are shuffled by hash.

Randomness comes from hashes of keys and the seed, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.store import Scratch
from fathomline.llm.words import WORD

#: Rows of a source in one block, and the most blocks that a source is cut into.
BLOCK_ROWS, MAX_BLOCKS = 256, 1 << 16
#: More sources than these are joined by a shuffle rather than sent to all executors.
BROADCAST_SOURCES = 20_000
#: The same for blocks of all sources, a few dozen bytes each.
BROADCAST_BLOCKS = 500_000
#: Ranges of a hash in which draws are put in order, a power of two; tasks that write one shard.
BUCKETS, FILES = 1024, 64


def targets(sources: DataFrame, weights: tuple[float, ...], max_repeat: float, share: float = 1.0) -> DataFrame:
    """Add weight, target and blocks to a table of (source, source_size, source_rows).

    Weights go to the sources by code point, null last, and repeat. All targets
    share ``share`` of all sizes by weight; one stops at max_repeat times its
    source's size, and the excess goes to the others by weight until none is above.
    With caps in ascending order of cap / weight the capped sources come first, so
    two running sums give the level that the others share.
    """
    whole = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    table = F.array(*[F.lit(float(w)) for w in weights])
    out = sources.withColumn("weight", F.element_at(table, ((F.row_number().over(whole) - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    out = out.withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    out = out.withColumn("_level", level)
    # the level of the first source that it does not cap holds for all from there on
    found = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    out = out.withColumn("target", F.least(F.col("_cap"), F.coalesce(found, F.lit(float("inf"))) * F.col("weight")))
    blocks = F.least(F.ceil(F.col("source_rows") / BLOCK_ROWS), F.lit(MAX_BLOCKS))
    return out.select("source", "source_size", "source_rows", "weight", "target", blocks.cast("int").alias("blocks"))


def deal(draws: DataFrame, scratch: Scratch, shards: int, seed: int) -> DataFrame:
    """Add shard to a table of draws by a splitting tree over shards.

    All draws stand in one random order. A node of n shards holds a run of them and
    sends the first part, in proportion, to its first half of the shards: of every
    source as many as a multivariate hypergeometric draw gives. The places in the
    order are counted within BUCKETS ranges of the hash, so no task sorts all draws.
    """
    hashed = draws.withColumn("_hash", F.xxhash64(F.lit(seed), "source", "block", "pass")).withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - BUCKETS.bit_length() + 1).cast("int"))
    hashed = scratch.save(hashed, "draws")
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy("_bucket").count().withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).withColumn("_size", F.sum("count").over(Window.partitionBy()))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", F.col("source").isNull(), "source", "block", "pass"))
    out = hashed.withColumn("_inside", inside).join(F.broadcast(counts.drop("count")), "_bucket")  # BUCKETS rows at most
    # of the run that the draw's node holds: its place in it (from 0) and its size; the node's first shard and their number
    out = out.withColumn("_place", F.col("_before") + F.col("_inside") - 1).withColumn("_low", F.lit(0)).withColumn("_n", F.lit(shards))
    for _ in range(max(0, (shards - 1).bit_length())):
        half = F.floor(F.col("_n") / 2).cast("int")
        first = F.floor(F.col("_size") * half / F.col("_n")).cast("long")
        out = out.withColumn("_half", half).withColumn("_first", first).withColumn("_left", F.col("_place") < F.col("_first"))
        out = out.select(
            *(c for c in out.columns if c not in ("_place", "_size", "_low", "_n")),
            F.when(F.col("_left"), F.col("_place")).otherwise(F.col("_place") - F.col("_first")).alias("_place"),
            F.when(F.col("_left"), F.col("_first")).otherwise(F.col("_size") - F.col("_first")).alias("_size"),
            F.when(F.col("_left"), F.col("_low")).otherwise(F.col("_low") + F.col("_half")).alias("_low"),
            F.when(F.col("_n") == 1, 1).when(F.col("_left"), F.col("_half")).otherwise(F.col("_n") - F.col("_half")).alias("_n"),
        ).drop("_half", "_first", "_left")
    return out.withColumn("shard", F.col("_low").cast("int")).select(*draws.columns, "shard")


@dataclass
class Mix:
    """rows: key, source, size, source_size, target, block, draws (array of pass and shard), taken.

    dealt has the draws of whole blocks by (source, block) and ends, for the one block
    of a source that its partial pass cuts, the draws of each row.
    """

    rows: DataFrame
    sources: DataFrame
    dealt: DataFrame
    ends: DataFrame
    seed: int


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(
    docs: DataFrame,
    scratch: Scratch,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_repeat: int = 3,
    shards: int = 16,
    seed: int = 11,
) -> Mix:
    """Decide how often each row of docs is taken, and into which shards.

    Null texts and texts without words have size 0 and are never needed for a
    target; they are taken with the block they fall in, for 0 words. A null source
    is a source of its own, the last. A null key is a key. Repeated rows share a
    block and are taken one by one. An empty table gives an empty result. Columns
    of docs other than the three are not read.
    """
    spark = docs.sparkSession
    # the text is read once for its size; the table kept holds small columns only
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = scratch.save(sized.withColumn("_hash", F.xxhash64(F.lit(seed), "key")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sources = scratch.save(targets(sources, weights, max_repeat), "sources")
    few = sources.count() <= BROADCAST_SOURCES
    known = sources.select(F.col("source").alias("_source"), "source_size", "target", "blocks")
    rows = sized.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("block", F.pmod("_hash", F.col("blocks")).cast("int"))

    # quotas: words up to each block, in the permuted order that the hash gives
    block = rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat))).otherwise(F.lit(0))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn("passes", passes.cast("int"))
    block = block.withColumn("left", F.col("target") - F.col("passes") * F.col("source_size") - F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    # left: words that the partial pass still lacks when it comes to the block
    whole = (F.col("left") >= F.col("words")) & (F.col("passes") < max_repeat)
    cut = (F.col("left") > 0) & ~whole & (F.col("passes") < max_repeat)
    block = block.withColumn("cut", cut).withColumn("n", F.col("passes") + F.when(whole | cut, 1).otherwise(0))
    block = scratch.save(block.select("source", "block", "left", "cut", "n"), "blocks")

    draws = block.where("n > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pass"))
    dealt = deal(draws, scratch, shards, seed).groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    dealt = block.where("n > 0").join(dealt.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "draws"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    dealt = scratch.save(dealt.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "left", "cut", "draws"), "dealt")

    met = rows.join(dealt, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left").drop("_source", "_block")
    # the one block that a source's partial pass ends in, row by row: take the rows that fit in permuted
    # order, then fill the gap from the smallest of the others or with the one row nearest to it in size,
    # whichever comes nearer to the target
    whole_block = Window.partitionBy("source")
    order = whole_block.orderBy("_hash", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = met.where(F.col("cut")).withColumn("_fits", F.sum("size").over(order) <= F.col("left"))
    taken = lambda test: F.sum(F.when(test, F.col("size")).otherwise(0)).over(whole_block)
    ends = ends.withColumn("_gap", F.col("left") - taken(F.col("_fits")))
    others = Window.partitionBy("source", "_fits")
    fill = others.orderBy("size", "_hash", "key").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_fill", ~F.col("_fits") & (F.coalesce(F.sum("size").over(fill), F.lit(0)) + F.col("size") / 2 <= F.col("_gap")))
    off = F.abs(F.col("_gap") - F.col("size"))
    ends = ends.withColumn("_one", ~F.col("_fits") & (F.row_number().over(others.orderBy(off, "_hash", "key")) == 1) & (off < F.col("_gap")))
    short = lambda test: F.abs(F.col("_gap") - taken(F.col(test)))
    ends = ends.withColumn("_single", short("_one") < short("_fill"))
    kept = F.col("_fits") | F.when(F.col("_single"), F.col("_one")).otherwise(F.col("_fill"))
    ends = ends.withColumn("draws", F.when(kept, F.col("draws")).otherwise(F.slice("draws", 1, F.size("draws") - 1))).drop("_fits", "_gap", "_fill", "_one", "_single")
    ends = scratch.save(ends, "ends")
    rest = met.where(F.coalesce(~F.col("cut"), F.lit(True)))
    out = rest.unionByName(ends)
    out = out.withColumn("draws", F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int>>")))
    return Mix(out.select("key", "source", "size", "source_size", "target", "block", "draws", (F.col("size") * F.size("draws")).alias("taken")), sources, dealt, ends, seed)


def _drawn(docs: DataFrame, made: Mix, key: str, text: str, source: str) -> DataFrame:
    """row, a struct of all columns of docs, key and draw: each row once for each of its draws.

    The draws of a whole block follow from a row's source and the hash of its key, so
    texts are not shuffled for them: the table of blocks is sent to all executors
    where it is small. Only rows of blocks that are cut meet their own draws by key
    and size, the first of equal rows the first draws. As rows are structs, no name of
    their columns matters.
    """
    few = made.sources.count() <= BROADCAST_SOURCES
    known = made.sources.select(F.col("source").alias("_source"), "blocks")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(source).alias("source"))
    rows = rows.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(made.seed), "key"), F.col("blocks")).cast("int"))
    small = made.dealt.count() <= BROADCAST_BLOCKS
    dealt = made.dealt.select("_source", "_block", "cut", "draws")
    met = rows.join(F.broadcast(dealt) if small else dealt, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    whole = met.where(~F.col("cut")).select("row", "key", "draws")
    own_text = F.col("row").getField(text)
    cut = met.where(F.col("cut")).select("row", "key", "source", word_count(own_text).alias("size"), F.xxhash64(own_text).alias("hash"))
    cut = cut.withColumn("number", F.row_number().over(Window.partitionBy("source", "key", "size").orderBy("hash")))
    own = made.ends.select(F.col("source").alias("_source"), F.col("key").alias("_key"), F.col("size").alias("_size"), "draws")
    own = own.withColumn("_number", F.row_number().over(Window.partitionBy("_source", "_key", "_size").orderBy(F.desc(F.size("draws")), F.col("draws").cast("string"))))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("size") == F.col("_size")) & (F.col("number") == F.col("_number"))
    cut = cut.join(own, same).select("row", "key", "draws")
    return whole.unionByName(cut).select("row", "key", F.explode("draws").alias("draw"))


def mix(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as plan() takes it.

    Null texts, keys and sources and repeated rows as in plan(); an empty table gives
    an empty mix. Columns of any name come back as they were.
    """
    made = plan(docs, scratch, key, text, source, **options)
    return _drawn(docs, made, key, text, source).select("row.*")


def write_mix(docs: DataFrame, path: str, scratch: Scratch, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> None:
    """Write the mix under path, a folder shard=N for each shard, the rows of each file in the order of a hash.

    A column shard of docs is replaced, all others are written as they were. Nulls and
    repeated rows as in plan(); an empty table writes no shards. A shard's blocks are
    drawn and shuffled by themselves, in up to FILES tasks a shard.
    """
    made = plan(docs, scratch, key, text, source, **options)
    out = _drawn(docs.drop("shard"), made, key, text, source)
    out = out.select("row", F.col("draw.shard").alias("shard"), F.xxhash64(F.lit(made.seed), "draw", "key").alias("place"))
    out = out.repartition("shard", F.pmod("place", F.lit(FILES))).sortWithinPartitions("shard", "place")
    out.select("row.*", "shard").write.partitionBy("shard").parquet(path)
