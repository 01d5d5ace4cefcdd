"""The contract queries: thin digests of the operators' results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .decontamination import contained_items
from .fingerprints import fingerprint_edits
from .mixing import entropy_mix
from .near_dedup import near_duplicates
from .quality import fit_quality, quality_scores
from .sharding import shard_documents
from .substring_dedup import repeated_passages
from .token_counts import token_counts
from .toxicity import fit_toxicity, toxicity_scores
from .warc import archive_folder, read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % takes of every document."""
    return entropy_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that repeat across documents."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text."""
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    pages = _table(spark, sf_dir, "pages")
    archives = write_archives(pages, archive_folder(pages))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal counts with equal texts together."""
    return shard_documents(_table(spark, sf_dir, "documents")).drop("hub")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every document."""
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles at similarity 0.8 over all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=80)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
}

ORACLES = {
    "op5_warc": oracles.WARC,
    "op7_decontamination": oracles.DECONTAMINATION,
    "op10_near_dedup": oracles.NEAR_DEDUP,
}
