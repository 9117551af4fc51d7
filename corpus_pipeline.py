"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of
``documents``. A runner writes each stage's result and reads it again for the next.

- ``quality``: documents that fail the base rules or lie outside the fences of their language and
  source go.
- ``line_dedup``: recurring lines go from all documents that hold them; a document that has no word
  left goes. ``n_chars`` is counted anew.
- ``jaccard``: one document of each group of near copies stays (five words, 80 percent), the one with
  the smallest doc_id.
- ``mix``: documents as drawn, in shuffled shards; a document that is drawn twice is there twice.
- ``bpe``: token ids of every whole text, checked by decoding them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, jaccard, lines, mixing, quality
from weftgraph.llm.common import WORD, Cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_recurring(docs, "__lines", "__dropped")
    kept = cleaned.where((F.col("__dropped") == 0) | F.col("text").rlike(WORD) | F.col("text").isNull())
    n_chars = F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return kept.select(*[n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, jaccard.Rule(5, 80))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).drop("shard")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a shard is one file of one row group, which one task reads whole; about even parts go to the encoders
    docs = docs.select("doc_id", "text").hint("rebalance")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("jaccard", jaccard_stage), ("mix", mix_stage), ("bpe", bpe_stage)]

#: SQL can't express the merges of the last stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; the stages between are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    before: Cut | None = None
    for name, stage in STAGES[:-1]:
        cut = Cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        docs, before = cut.df, cut
    return STAGES[-1][1](spark, docs, sf_dir)
