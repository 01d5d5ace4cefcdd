"""Exact nearest neighbours by inner product; blocks of queries are dealt to tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.scoring import dot, unit

#: Queries of one block: its matrix and best rows are what a task holds.
QUERY_BLOCK = 1024
#: Vectors of one packed row.
PACK = 1024


def _packed(kind: str):
    """A task's vectors in rows of up to ``PACK``: ``docs``, ``matrix`` (their bytes) and ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PACK):
                part = batch.slice(at, PACK)
                flat = np.asarray(part.column("embedding").flatten().to_numpy(zero_copy_only=False), kind)
                ids = pa.array([part.column("id").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([flat.tobytes()], pa.binary()), pa.array([len(part)], pa.int32())], names=["docs", "matrix", "n"])

    return run


def _matrix(matrix: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(matrix, kind).reshape(n, -1).astype(np.float64)


def _cut(row: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of each row by score, then the lower document; rows in order."""
    order = np.lexsort((doc, -np.round(score, 9), row))
    ordered = row[order]
    order = order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]
    return row[order], doc[order], score[order]


class _Best:
    """The best ``k`` documents of a block's queries so far; what a full query's k-th excludes is dropped at once."""

    def __init__(self, ids: list, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.count, self.least = 0, np.full((len(ids), 1), -np.inf)

    def add(self, docs: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.matrix @ vectors.T
        row, column = np.nonzero(scores >= self.least)
        self.parts.append((row, docs[column], scores[row, column]))
        self.count += len(row)
        if self.count > 3 * self.k * len(self.ids):
            row, doc, score = self.cut()
            full = np.bincount(row, minlength=len(self.ids)) >= self.k
            last = np.searchsorted(row, np.flatnonzero(full), "right") - 1
            self.least[full, 0] = score[last] - 2e-9  # ties at nine decimals stay
            self.parts, self.count = [(row, doc, score)], len(row)

    def cut(self) -> tuple[np.ndarray, ...]:
        return _cut(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.k)

    def told(self) -> Iterator[pa.RecordBatch]:
        row, doc, score = self.cut() if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ids = pa.array(self.ids, pa.string())
        for at in range(0, len(row), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[part])), pa.array(doc[part]), pa.array(score[part])], names=["topic_id", "doc_ord", "score"])


def _nearest(k: int, kind: str):
    """The best of each query of the blocks in a partition; a block's queries come before its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for batch in batches:
            for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
                if row["block"] != block:
                    if best is not None:
                        yield from best.told()
                    block, best = row["block"], None
                if row["topics"] is not None:
                    best = _Best(row["topics"], _matrix(row["matrix"], row["n"], kind), k)
                elif best is not None:
                    best.add(np.asarray(row["docs"], np.int64), _matrix(row["matrix"], row["n"], kind))
        if best is not None:
            yield from best.told()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 1000, block: int = QUERY_BLOCK, least: int | None = None) -> DataFrame:
    """``topic_id, doc_ord, score, rank`` of the ``k`` best of each query.

    ``vectors(doc_ord, embedding)`` and ``queries(topic_id, embedding)`` hold
    vectors of one length, none null. Scores tie at nine decimals, broken by
    the lower ordinal. Queries are dealt out in blocks of about ``block``, or
    of ``least`` while there are cores for more. The vectors, packed, go to
    each block's task, which reads them as a stream and holds one block's best
    rows; nothing of either goes through the driver but the number of queries.
    All pairs are compared: work and shuffle grow as vectors times blocks.
    """
    spark, n = vectors.sparkSession, queries.count()
    blocks = max(1, -(-n // block), min(2 * spark.sparkContext.defaultParallelism, -(-n // (least or block))))
    single = all(df.schema["embedding"].dataType == ArrayType(FloatType()) for df in (vectors, queries))
    kind, embedding = ("<f4" if single else "<f8"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding")
    asked = queries.select(F.pmod(F.xxhash64(F.col("topic_id").cast("string")), F.lit(blocks)).cast("int").alias("block"), F.struct(F.col("topic_id").cast("string").alias("id"), embedding).alias("row"))
    listed = asked.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    heads = listed.mapInArrow(_heads(kind), "block int, topics array<string>, docs array<bigint>, matrix binary, n int")
    packs = vectors.select(F.col("doc_ord").cast("long").alias("id"), embedding).mapInArrow(_packed(kind), "docs array<bigint>, matrix binary, n int")
    every = packs.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("array<string>").alias("topics"), "docs", "matrix", "n")
    together = heads.unionByName(every).repartition(blocks, "block").sortWithinPartitions("block", F.col("topics").isNull())
    found = together.mapInArrow(_nearest(k, kind), "topic_id string, doc_ord long, score double")
    order = Window.partitionBy("topic_id").orderBy(F.round("score", 9).desc(), "doc_ord")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _heads(kind: str):
    """Each block's queries in one row: ``block, topics, docs`` (null), ``matrix, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows = batch.column("rows")[i].values
                ids, flat = rows.field("id").to_pylist(), rows.field("embedding").flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(i, 1), pa.array([ids], pa.list_(pa.string())), pa.array([None], pa.list_(pa.int64())), pa.array([np.asarray(flat, kind).tobytes()], pa.binary()), pa.array([len(ids)], pa.int32())],
                    names=["block", "topics", "docs", "matrix", "n"],
                )

    return run


def nearest_native(vectors: DataFrame, queries: DataFrame, k: int = 1000) -> DataFrame:
    """The same as column expressions; ``queries`` must be a small set."""
    pairs = vectors.select("doc_ord", "embedding").crossJoin(queries.select("topic_id", F.col("embedding").alias("asked")))
    order = Window.partitionBy("topic_id").orderBy(F.round("score", 9).desc(), "doc_ord")
    scored = pairs.select("topic_id", "doc_ord", dot(F.col("embedding"), F.col("asked")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalised(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", unit(F.col("embedding")))
