"""BM25, feedback expansion and passage reranking of many topics in one plan.

A bounded number of topic terms (``MOST_TERMS``) is weighed at once and pushed
into the scans of a saved index; more are joined as tables. What a plan reads
twice (base scores, a ranking's prefix) is kept by the executors, recomputed if
one is lost, until ``release`` or the session's cache is cleared. Scores are ranked at nine decimals, ties by the higher ordinal, so that the
order of a distributed sum cannot change a ranking.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..config import Ranking
from ..functions import scan
from ..functions.scoring import bm25, idf
from .index import Index

#: Rows of topic terms, or documents of a feedback or passage prefix, that are listed on the driver at most.
MOST_TERMS = 20_000
_kept: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """``df``, held by the executors until ``release``."""
    _kept.append(df.persist())
    return df


def release() -> None:
    """Free what searches so far have kept; their frames recompute it if read again."""
    while _kept:
        _kept.pop().unpersist()


def _best_first(partition: str = "topic_id") -> Window:
    return Window.partitionBy(partition).orderBy(F.round("score", 9).desc(), F.desc("doc_ord"))


def query_terms(topics: DataFrame) -> DataFrame:
    """``topic_id``, ``term``, ``weight``: each occurrence of a word weighs 1."""
    return topics.select("topic_id", F.explode("words").alias("term")).groupBy("topic_id", "term").agg(F.count("*").cast("double").alias("weight"))


def weighed(index: Index, terms: DataFrame) -> DataFrame:
    """Distinct terms with ``idf``; absent and ubiquitous ones dropped."""
    found = index.frequencies(terms.select("term").distinct()).crossJoin(index.statistics())
    return found.where("df < n_docs").select("term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_len")


def bounded(rows: DataFrame, most: int = MOST_TERMS) -> list | None:
    """The rows if they are at most ``most``, else None."""
    listed = rows.limit(most + 1).collect()
    return listed if len(listed) <= most else None


def listed(rows: DataFrame) -> DataFrame:
    """A bounded number of rows as a table of their own, so that they are computed once."""
    here = bounded(rows)
    return rows if here is None else rows.sparkSession.createDataFrame(here, rows.schema)


def asked(index: Index, terms: DataFrame) -> scan.Asked | None:
    """The known terms with their gains for a scan of the index's texts; None if it has none or the terms are too many."""
    here = None if index.texts is None else bounded(terms.select("topic_id", "term", F.col("weight").cast("double").alias("weight")))
    if here is None:
        return None
    df = index.frequencies_in(sorted({r["term"] for r in here}))
    n_docs, avg_len = index.totals()
    known = [r for r in here if 0 < df[r["term"]] < n_docs]
    names, topics = sorted({r["term"] for r in known}), sorted({r["topic_id"] for r in known})
    term, topic = ({x: i for i, x in enumerate(xs)} for xs in (names, topics))
    return scan.Asked(names, topics, [(topic[r["topic_id"]], term[r["term"]], r["weight"] * math.log(n_docs / df[r["term"]])) for r in known], avg_len)


def gains(index: Index, terms: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """``topic_id, term, gain, avg_len`` of known terms; and their names, if bounded."""
    wanted = terms.select("topic_id", "term", F.col("weight").cast("double").alias("weight"))
    here = bounded(wanted)
    if here is None:
        return wanted.join(weighed(index, terms), "term").select("topic_id", "term", (F.col("weight") * F.col("idf")).alias("gain"), "avg_len"), None
    df = index.frequencies_in(sorted({r["term"] for r in here}))
    n_docs, avg_len = index.totals()
    rows = [(r["topic_id"], r["term"], r["weight"], df[r["term"]]) for r in here if 0 < df[r["term"]] < n_docs]
    made = terms.sparkSession.createDataFrame(rows, f"topic_id {dict(terms.dtypes)['topic_id']}, term string, weight double, df long")
    gain = (F.col("weight") * idf(F.lit(n_docs), F.col("df"))).alias("gain")
    return made.select("topic_id", "term", gain, F.lit(float(avg_len)).alias("avg_len")), sorted({r[1] for r in rows})


def matches(index: Index, terms: DataFrame) -> DataFrame:
    """``topic_id, term, doc_ord, tf, doc_len, avg_len, gain`` (weight * idf)."""
    known, names = gains(index, terms)
    if names is None:
        return index.postings_of(known.select("term").distinct()).join(known, "term")
    return index.postings_in(names).join(F.broadcast(known), "term")


def score(found: DataFrame, k1: float | Column, b: float | Column, keys: tuple[str, ...] = ("topic_id", "doc_ord")) -> DataFrame:
    part = F.col("gain") * bm25(F.col("tf"), F.col("doc_len"), F.col("avg_len"), k1, b)
    return found.groupBy(*keys).agg(F.sum(part).alias("score"))


def top(scores: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each topic with ``rank`` from 1."""
    return scores.withColumn("rank", F.row_number().over(_best_first())).where(F.col("rank") <= n)


def rank_bm25(index: Index, terms: DataFrame, ranking: Ranking = Ranking(), most: int | None = None) -> DataFrame:
    """``topic_id, doc_ord, score``. With ``most``, rows beyond a topic's first ones may be left out."""
    known = asked(index, terms)
    if known is None:
        return score(matches(index, terms), ranking.k1, ranking.b)
    kind = terms.schema["topic_id"].dataType
    schema = StructType().add("topic_id", kind).add("doc_ord", "long").add("score", "double")
    return index.scanned(scan.scores(lambda: known, ranking.k1, ranking.b, most, to_arrow_type(kind)), schema)


def _documents(index: Index, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forward documents that ``docs(topic_id, doc_ord, ...)`` lists, and the list.

    A bounded list is pushed into the scan and broadcast, so a document that
    several topics list is taken apart once.
    """
    here = bounded(docs)
    if here is None:
        return index.forward.join(docs.select("doc_ord").distinct(), "doc_ord", "left_semi"), docs
    few = docs.sparkSession.createDataFrame(here, docs.schema)
    return index.forward.where(F.col("doc_ord").isin(sorted({r["doc_ord"] for r in here}))), F.broadcast(few)


def expansion_terms(index: Index, terms: DataFrame, scores: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """``topic_id, term, weight`` that feedback adds to each topic.

    The first ``feedback_docs`` vote with their share of positive scores (with
    1/rank if there are none): raw frequency over weighted length times idf.
    Terms of the topic itself don't count; the best remain and share
    ``expansion_weight``.
    """
    r = ranking
    if not (r.feedback_docs and r.expansion_terms and r.expansion_weight):
        return terms.limit(0)
    mass = F.sum(F.greatest("score", F.lit(0.0))).over(Window.partitionBy("topic_id"))
    voters = top(scores, r.feedback_docs).withColumn("mass", mass)
    voters = voters.select("topic_id", "doc_ord", F.when(F.col("mass") > 0, F.greatest("score", F.lit(0.0)) / F.when(F.col("mass") > 0, F.col("mass")).otherwise(1.0)).otherwise(F.lit(1.0) / F.col("rank")).alias("vote"))
    chosen, votes = _documents(index, voters)
    words = chosen.select("doc_ord", "doc_len", F.explode("terms").alias("term"))
    counts = words.groupBy("doc_ord", "doc_len", "term").agg(F.count("*").alias("tf")).join(votes, "doc_ord")
    fresh = counts.join(terms.select("topic_id", "term"), ["topic_id", "term"], "left_anti")
    voted = fresh.groupBy("topic_id", "term").agg(F.sum(F.col("vote") * F.col("tf") / F.col("doc_len")).alias("vote"))
    n_docs, _ = index.totals()
    gained = index.with_frequencies(voted).where(F.col("df") < n_docs).select("topic_id", "term", (F.col("vote") * idf(F.lit(n_docs), F.col("df"))).alias("gain"))
    order = Window.partitionBy("topic_id").orderBy(F.round("gain", 12).desc(), "term")
    best = gained.where("gain > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= r.expansion_terms)
    total = F.sum("gain").over(Window.partitionBy("topic_id"))
    return best.withColumn("weight", F.col("gain") / total * r.expansion_weight).select("topic_id", "term", "weight")


def gated(topics: DataFrame, ranking: Ranking) -> DataFrame:
    """Topics short enough to expand (all, if the limit is 0)."""
    if not ranking.max_query_terms:
        return topics.select("topic_id")
    return topics.where(F.size("words") <= ranking.max_query_terms).select("topic_id")


def expanded(index: Index, topics: DataFrame, terms: DataFrame, base: DataFrame | None = None, ranking: Ranking = Ranking()) -> DataFrame:
    """``topic_id, term, weight`` that feedback adds to the topics short enough; ``base`` are their BM25 scores, if at hand."""
    base = rank_bm25(index, terms, ranking, ranking.feedback_docs) if base is None else base
    return listed(expansion_terms(index, terms, base.join(gated(topics, ranking), "topic_id", "left_semi"), ranking))  # expansion_terms a topic at most


def feedback_terms(terms: DataFrame, more: DataFrame, only: bool) -> DataFrame:
    """Topics' terms with those that feedback adds; or those alone, where there are any."""
    own = terms.select("topic_id", "term", "weight")
    return (own.join(more.select("topic_id").distinct(), "topic_id", "left_anti") if only else own).unionByName(more)


def rank_feedback(index: Index, topics: DataFrame, ranking: Ranking = Ranking(), terms: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """BM25 plus expansion terms; or by those alone, where there are any. ``most`` as in ``rank_bm25``."""
    terms = listed(query_terms(topics)) if terms is None else terms
    more = expanded(index, topics, terms, ranking=ranking)
    return rank_bm25(index, listed(feedback_terms(terms, more, ranking.expansion_only)), ranking, most)


def passage_scores(index: Index, terms: DataFrame, docs: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """``passage`` of each (topic_id, doc_ord) in ``docs`` that has one.

    Over all stretches between two occurrences of topic terms, at most
    ``rerank_window`` places long and with two distinct terms, the largest sum
    of weight * idf * saturation, with the stretch as length and the window as
    mean length.
    """
    window = ranking.rerank_window
    known, names = gains(index, terms)
    chosen, pairs = _documents(index, docs.select("topic_id", "doc_ord"))
    places = chosen.select("doc_ord", F.posexplode("terms").alias("pos", "term"))
    places = (places if names is None else places.where(F.col("term").isin(names))).join(pairs, "doc_ord")
    hits = places.join(known.select("topic_id", "term", "gain") if names is None else F.broadcast(known.select("topic_id", "term", "gain")), ["topic_id", "term"])
    frame = Window.partitionBy("topic_id", "doc_ord").orderBy("pos").rangeBetween(-(window - 1), 0)
    seen = hits.withColumn("seen", F.sort_array(F.collect_list(F.struct("pos", "term", "gain")).over(frame))).where(F.size("seen") > 1)

    def stretch(start: Column) -> Column:
        part = F.slice(F.col("seen"), start, F.size("seen"))
        span = (F.col("pos") - F.get(part, F.lit(0))["pos"] + 1).cast("double")
        kinds = F.array_distinct(F.transform(part, lambda o: F.struct(o["term"].alias("term"), o["gain"].alias("gain"))))

        def add(total: Column, kind: Column) -> Column:
            count = F.size(F.filter(part, lambda o: o["term"] == kind["term"])).cast("double")
            return total + kind["gain"] * bm25(count, span, F.lit(float(window)), ranking.k1, ranking.b)

        return F.when(F.size(kinds) > 1, F.aggregate(kinds, F.lit(0.0), add)).otherwise(F.lit(0.0))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("seen") - 1), stretch))
    return seen.withColumn("best", best).groupBy("topic_id", "doc_ord").agg(F.max("best").alias("passage")).where("passage > 0")


def rerank_passages(index: Index, terms: DataFrame, scores: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """Scores with the first ``rerank_docs`` reordered by their best passage.

    Adds ``rank`` (1 to ``results``); only the reordered prefix's scores change.
    """
    if not (ranking.rerank_docs and ranking.rerank_window and ranking.rerank_weight):
        return top(scores, ranking.results)
    placed = top(scores, max(ranking.results, ranking.rerank_docs)).withColumn("prefix", F.col("rank") <= ranking.rerank_docs)
    placed = kept(placed)  # that many rows a topic at most
    passages = passage_scores(index, terms, placed.where(F.col("rank") <= ranking.rerank_docs), ranking)
    scored = placed.join(passages, ["topic_id", "doc_ord"], "left").withColumn("score", F.col("score") + F.when(F.col("prefix"), F.coalesce("passage", F.lit(0.0)) * ranking.rerank_weight).otherwise(0.0))
    order = Window.partitionBy("topic_id").orderBy(F.desc("prefix"), F.round("score", 9).desc(), F.desc("doc_ord"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranking.results).select("topic_id", "doc_ord", "score", "rank")


def search(index: Index, topics: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """The default sparse query: feedback, passages, the first 1000."""
    terms = listed(query_terms(topics))
    return rerank_passages(index, terms, rank_feedback(index, topics, ranking, terms, max(ranking.results, ranking.rerank_docs)), ranking)
