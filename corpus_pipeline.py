"""Five stages that turn raw documents into a sharded training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it back as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.decontamination import contained_items
from quillrank.llm.mixing import mixed_documents
from quillrank.llm.near_dedup import near_duplicates
from quillrank.llm.quality import fit_quality, keep_quality
from quillrank.llm.sharding import shard_documents
from quillrank.llm.storage import stored

#: Up to so many ids of dropped or repeated documents are broadcast.
BROADCAST_IDS = 500_000
#: No SQL expresses the trained classifier.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(docs: DataFrame) -> Column:
    """A row's own number: a hash of its document; equal documents have equal ones."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _without(docs: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """``docs`` without those whose ``key`` is in ``rows``."""
    dropped = stored(rows.select(F.col(rows.columns[0]).alias("__dropped")).distinct(), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, key == F.col("__dropped"), "left_anti")


def _one_each(docs: DataFrame) -> DataFrame:
    """One row of each document that repeats (equal id and text); only these move."""
    again = docs.groupBy(_row(docs).alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again")
    again = stored(again, "repeated")
    few = again.count()
    if not few:
        return docs
    listed = F.broadcast(again) if few <= BROADCAST_IDS else again
    marked = docs.withColumn("__row", _row(docs))
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = marked.join(listed, F.col("__row") == F.col("__again"), "left_anti").select(*names)
    many = marked.join(listed, F.col("__row") == F.col("__again"), "left_semi").groupBy("__row").agg(F.min(F.struct(*names)).alias("__first"))
    return once.union(many.select(*[F.col(f"__first.`{c}`").alias(c) for c in docs.columns]))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the given labels, accepts."""
    return keep_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near duplicates.

    Repeated rows count once. Where ids repeat or are null, documents are
    told apart by id and text, and the one of the smallest hash stays.
    """
    rows = _one_each(docs)
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not ids:
        return _without(rows, near_duplicates(rows).where("not kept").select("doc_id"), F.col("doc_id"))
    named = rows.select(_row(rows).alias("doc_id"), "text")
    return _without(rows, near_duplicates(named).where("not kept").select("doc_id"), _row(rows))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    named = docs.select(_row(docs).alias("doc_id"), "text")
    return _without(docs, contained_items(named, _table(spark, sf_dir, "benchmark")).select("doc_id"), _row(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target mix takes it."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
