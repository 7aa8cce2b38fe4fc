"""The corpus pipeline: language, near-duplicates, benchmark leaks, mix, token ids.

Each stage takes the documents that its predecessor kept and returns documents
with all their columns, the last one the packed documents. Stages work on all
rows; a stage that filters keeps what it has no reason to reject.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import decontaminate, langid, minhash, mixing, packing
from fathomline.llm.store import Scratch

TOKENIZER = "word_bpe_49k.json"
END_ID = 2

_open: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """Tables of one stage; run() deletes them once the stage's rows are written."""
    _open.append(Scratch(spark, name))
    return _open[-1]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters, and those of 20 letters or more that are not like any language learned from the labelled rows: foreign scripts, and a few words over and over."""
    model = langid.train(docs)
    return langid.known_only(docs, model, langid.limits(docs, model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, similarity 0.8), the one with the least doc_id."""
    return minhash.deduplicate(docs, _scratch(spark, "dedup"), size=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that hold a benchmark item, up to a fifth of its words changed (items of 4 to 7 words exactly)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _scratch(spark, "leaks"), percent=20)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents so that sources meet their weights (5, 2, 1 in turn; a document three times at most)."""
    return mixing.mix(docs, _scratch(spark, "mix"), weights=(5.0, 2.0, 1.0), max_repeat=3, shards=16)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and pack what is left, and read it back: doc_id, start, n_tokens, ids_crc32."""
    path = public_tokenizers.path(TOKENIZER)
    return packing.write_and_read(docs, _scratch(spark, "ids"), path, packing.vocabulary(path), end=END_ID)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mix", mix),
    ("token_ids", token_ids),
]

#: Near-duplicates, edit distances and hash orders have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again; the rows of the last. What a stage has read is deleted behind it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        while _open:
            _open.pop().clear()
        scratch.drop_all_but(name)
    return docs
