"""The thin queries op1 to op10 and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, chat, fingerprint, html, jaccard, licenses, lines, mixing, quality, sharding
from weftgraph.llm.common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses of every document, by patience alignment with all templates."""
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the formatted texts."""
    return chat.formatted_digests(table(spark, sf_dir, "conversations"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without its recurring lines, n_lines, n_dropped of every document."""
    return lines.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Arrivals in which op5 takes the documents.
ARRIVALS = 16


def op5_shard_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, text_sha256 of every document, read back from the compacted store's last version."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", docs.schema)
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum(0)  # nobody else has this store
    return store.read().select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: four words, 85 percent."""
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Rule(4, 85))


def op9_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprint.edited_digests(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of documents."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_chat_format": op2_chat_format,
    "op3_quality_rules": op3_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op5_shard_store": op5_shard_store,
    "op6_source_mix": op6_source_mix,
    "op7_jaccard_join": op7_jaccard_join,
    "op9_piecewise_hash": op9_piecewise_hash,
    "op10_main_text": op10_main_text,
    "op8_byte_bpe": op8_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op5_shard_store": "SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM documents",
    "op2_chat_format": chat.ORACLE,
}
