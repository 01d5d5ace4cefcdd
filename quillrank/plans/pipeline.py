"""The hybrid pipeline: sparse and dense sources, fusion, optional reranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SOURCES, Ranking
from ..operators.dense import nearest
from ..operators.fusion import ablations, richest
from ..operators.index import Index
from ..operators.sparse import query_terms, rank_bm25, rank_feedback, top

PLAIN = Ranking(rerank_docs=0)


def _run(scores: DataFrame, index: Index, ranking: Ranking) -> DataFrame:
    best = top(scores, ranking.results)
    return best.join(index.forward.select("doc_ord", "doc_no"), "doc_ord").select("topic_id", "doc_no", "score", "rank")


def source_runs(index: Index, topics: DataFrame, rewritten: DataFrame | None = None, vectors: DataFrame | None = None, asked: DataFrame | None = None, ranking: Ranking = PLAIN) -> dict[str, DataFrame]:
    """One run per source that the given inputs allow; passages stay off."""
    only = replace(ranking, expansion_only=True)
    runs = {
        "bm25": _run(rank_bm25(index, query_terms(topics), ranking), index, ranking),
        "rm3": _run(rank_feedback(index, topics, ranking), index, ranking),
        "rm3exp": _run(rank_feedback(index, topics, only), index, ranking),
    }
    if rewritten is not None:
        runs["rewrite"] = _run(rank_bm25(index, query_terms(rewritten), ranking), index, ranking)
        runs["rwexp"] = _run(rank_feedback(index, rewritten, only), index, ranking)
    if vectors is not None and asked is not None:
        found = nearest(vectors, asked, ranking.results)
        runs["dense"] = found.join(index.forward.select("doc_ord", "doc_no"), "doc_ord").select("topic_id", "doc_no", "score", "rank")
    return runs


def hybrid(index: Index, topics: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None = None, **inputs: DataFrame) -> DataFrame:
    """The richest fusion that the inputs allow, reranked where a reranker is given."""
    made = ablations(source_runs(index, topics, **inputs), list(SOURCES))
    final = made[richest(made)]
    return rerank(final) if rerank else final.select("topic_id", "doc_no", F.col("score"), "rank")
