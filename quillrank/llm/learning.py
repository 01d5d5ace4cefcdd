"""Labelled samples of bounded size, shared by the trained classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from every fit: crc32 of its id modulo 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _learnable(labels: DataFrame, column: str) -> DataFrame:
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(column).cast("int").alias("y"))


def class_counts(labels: DataFrame, column: str) -> dict[int, int]:
    """Learnable labels of each class, those beyond a sample's bound too."""
    return {r["y"]: r["count"] for r in _learnable(labels, column).groupBy("y").count().collect()}


def sample_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` learnable labels of each class, by hash of the id.

    ``labels`` needs ``doc_id`` and ``column`` (0 or 1; others and nulls are
    left out). An id with both labels counts as 1. Returns ``id``, ``y``.
    """
    each = _learnable(labels, column)
    mixed = F.xxhash64("id", F.lit(17))
    return each.where("y = 1").orderBy(mixed, "id").limit(rows).union(each.where("y = 0").orderBy(mixed, "id").limit(rows))


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null: empty), ``y``: one row per sampled id that ``docs`` has.

    Of the texts of a repeated id the smallest counts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("id"))  # the sample's bound holds
    return chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
