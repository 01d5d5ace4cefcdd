"""Weighted reciprocal-rank fusion, tail completion and ablations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RRF_K, Source
from .sparse import kept


def _labelled(runs: dict[str, DataFrame], sources: list[Source]) -> DataFrame:
    parts = [
        runs[s.label].select("topic_id", "doc_no", "rank").withColumns({"weight": F.lit(float(s.weight)), "depth": F.lit(s.depth), "place": F.lit(i)}) for i, s in enumerate(sources)
    ]
    listed = reduce(DataFrame.unionByName, parts)
    return listed.withColumn("entry", F.row_number().over(Window.partitionBy("topic_id", "place").orderBy("rank", "doc_no")))


def _fused(listed: DataFrame, k: int) -> DataFrame:
    counted = listed.where((F.col("depth") == 0) | (F.col("entry") <= F.col("depth")))
    scores = counted.groupBy("topic_id", "doc_no").agg(F.sum(F.col("weight") / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))
    order = Window.partitionBy("topic_id").orderBy(F.round("score", 12).desc(), "best_rank", "doc_no")
    return scores.withColumn("rank", F.row_number().over(order))


def fuse(runs: dict[str, DataFrame], sources: list[Source], k: int = RRF_K) -> DataFrame:
    """``topic_id, doc_no, score, best_rank, rank`` of ``runs(topic_id, doc_no, rank)``.

    A source's first ``depth`` entries (0: all) each add weight / (k + rank), a
    document listed twice adding twice; ties by best rank, then name.
    """
    return _fused(_labelled(runs, sources), k)


def fuse_with_tail(runs: dict[str, DataFrame], sources: list[Source], k: int = RRF_K) -> DataFrame:
    """``fuse`` followed by every other listed document, sources in turn.

    The i-th of them scores 1e-9 * i below the last fused one (0 if none).
    """
    listed = _labelled(runs, sources)
    prefix = kept(_fused(listed, k))  # the sources' depths a topic at most
    rest = listed.join(prefix.select("topic_id", "doc_no"), ["topic_id", "doc_no"], "left_anti")
    first = rest.groupBy("topic_id", "doc_no").agg(F.min(F.struct("place", "entry")).alias("at"))
    tail = first.withColumn("i", F.row_number().over(Window.partitionBy("topic_id").orderBy("at", "doc_no")))
    floor = prefix.groupBy("topic_id").agg(F.min_by("score", -F.col("rank")).alias("floor"), F.max("rank").alias("n"))
    tail = tail.join(floor, "topic_id", "left").select("topic_id", "doc_no", (F.coalesce("floor", F.lit(0.0)) - F.col("i") * 1e-9).alias("score"), (F.coalesce("n", F.lit(0)) + F.col("i")).alias("rank"))
    return prefix.select("topic_id", "doc_no", "score", "rank").unionByName(tail)


# The combinations that are compared with one another.
ABLATIONS = {
    "bm25_rm3": ["bm25", "rm3"], "bm25_dense": ["bm25", "dense"], "bm25_rm3_dense": ["bm25", "rm3", "dense"],
    "bm25_rm3_rm3exp": ["bm25", "rm3", "rm3exp"], "bm25_rm3_rm3exp_dense": ["bm25", "rm3", "rm3exp", "dense"],
    "bm25_rm3_rewrite": ["bm25", "rm3", "rewrite"], "bm25_rm3_rm3exp_rewrite": ["bm25", "rm3", "rm3exp", "rewrite"],
    "bm25_rm3_rm3exp_rewrite_rwexp": ["bm25", "rm3", "rm3exp", "rewrite", "rwexp"],
    "all": ["bm25", "rm3", "rm3exp", "rewrite", "rwexp", "dense"],
}


def ablations(runs: dict[str, DataFrame], sources: list[Source], k: int = RRF_K) -> dict[str, DataFrame]:
    """Every combination whose sources are at hand, fused with its tail, and BM25 alone."""
    known = {s.label: s for s in sources}
    made = {name: fuse_with_tail(runs, [known[x] for x in labels], k) for name, labels in ABLATIONS.items() if set(labels) <= set(runs)}
    return made | ({"bm25": runs["bm25"]} if "bm25" in runs else {})


def richest(made: dict[str, DataFrame]) -> str:
    """The name of the combination with the most sources."""
    return max(made, key=lambda name: (len(ABLATIONS.get(name, [name])), name))
