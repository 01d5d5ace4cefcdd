"""The engine's queries over the driver's tables, by name.

documents become an index, benchmark passages topics (their first two to seven
words) and judgments, embeddings vectors, pages tagged documents. Model
answers are stand-ins computed from ids and texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Ranking, Source
from ..functions import scan
from ..functions.scoring import unit
from ..functions.text import body_terms, raw_tokens, token_estimate, topic_words
from ..llm.storage import settled
from ..operators import evaluate, fusion, neural, report, sparse, tuning
from ..operators.dense import nearest
from ..operators.index import Index, index_plain, text_prefix
from ..sources.collections import Fields, weighted_tokens
from ..sources.runs import printed
from . import oracles
from .settings import BRANCHES, GRID_DOCS, GRID_WEIGHTS, GRID_WINDOWS

RANKING = Ranking()
PAGE_FIELDS = Fields(ignored=("script", "style"), boosted="title", key=None, by_name=True)
TWO = [Source("bm25", 0.6, 250), Source("rm3", 0.4, 250)]
TRI = [Source("bm25", 0.05, 250), Source("rm3", 0.55, 250), Source("rm3exp", 0.40, 250)]
#: Queries of a block of the registered search at least, while there are cores for more blocks.
DENSE_BLOCK = 32
SHALLOW = [Source("bm25", 0.6, 20), Source("rm3", 0.4, 20)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shared: dict[tuple, object] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, make: Callable[[], object]):
    """What queries of one session over one folder share."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The documents' index, which remembers its totals and frequencies."""
    return _once("index", spark, sf_dir, lambda: _indexed(spark, sf_dir))


def _indexed(spark: SparkSession, sf_dir: str) -> Index:
    docs = table(spark, sf_dir, "documents")
    return index_plain(docs.select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("doc_no"), "text"))


def topics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``topic_id, text, words``: a passage's first 2 + id % 6 tokens."""
    items = table(spark, sf_dir, "benchmark")
    first = F.slice(raw_tokens(F.col("text")), F.lit(1), (F.col("item_id") % 6 + 2).cast("int"))
    return items.select("item_id", F.array_join(first, " ").alias("text")).select(F.col("item_id").cast("string").alias("topic_id"), "text", topic_words(F.concat(F.col("item_id").cast("string"), F.lit(" "), F.col("text"))).alias("words"))


def relevant_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``topic_id, doc_no`` where the document contains the passage's first 60 characters."""
    return _once("relevant", spark, sf_dir, lambda: _relevant(spark, sf_dir))


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("topic_id"), F.substring("text", 1, 60).alias("head"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_no"), "text")
    heads = sparse.bounded(items.where("head is not null"))
    if heads is None:
        found = docs.join(items, F.contains("text", "head")).select("topic_id", "doc_no")
    else:
        found = docs.mapInArrow(scan.holding([(r["topic_id"], r["head"]) for r in heads], pa.string()), "topic_id string, doc_no string")
    return settled(found.distinct(), "relevant")


def poor_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_no`` judged not relevant, for every topic that they are not relevant to: low quality labels."""
    return table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_no")).distinct()


def qrels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All judgments, those that are not relevant listed with every topic."""
    relevant = relevant_of(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("topic_id"))
    not_relevant = poor_of(spark, sf_dir).crossJoin(items).join(relevant, ["topic_id", "doc_no"], "left_anti")
    return relevant.withColumn("rel", F.lit(1)).unionByName(not_relevant.select("topic_id", "doc_no").withColumn("rel", F.lit(0)))


def _judgments(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The judgments as an evaluation reads them."""
    return {"qrels": relevant_of(spark, sf_dir).withColumn("rel", F.lit(1)), "poor": poor_of(spark, sf_dir)}


def _published(run: DataFrame) -> DataFrame:
    return run.select("topic_id", "doc_ord", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _named(run: DataFrame, decimals: int = 6) -> DataFrame:
    return run.select("topic_id", "doc_no", F.col("rank").cast("long").alias("rank"), F.round("score", decimals).alias("score"))


def _runs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """BM25, feedback and expansion-only rankings under document names, 1000 a topic."""
    return _once("runs", spark, sf_dir, lambda: _ranked(spark, sf_dir))


def _ranked(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    index, topics = index_of(spark, sf_dir), topics_of(spark, sf_dir)
    terms = sparse.listed(sparse.query_terms(topics))

    def first(scores: DataFrame, label: str) -> DataFrame:
        return settled(sparse.top(scores, RANKING.results), label)

    base = first(sparse.rank_bm25(index, terms, RANKING, RANKING.results), "run_bm25")
    more = sparse.expanded(index, topics, terms, base.select("topic_id", "doc_ord", "score"))
    name = lambda kind: F.concat(F.lit(f"{kind} "), F.col("topic_id")).alias("topic_id")
    both = [sparse.feedback_terms(terms, more, kind == "rm3exp").select(name(kind), "term", "weight") for kind in ("rm3", "rm3exp")]
    fed = first(sparse.rank_bm25(index, sparse.listed(both[0].unionByName(both[1])), RANKING, RANKING.results), "run_fed")  # one scan for both
    kind, topic = F.split("topic_id", " ", 2)[0], F.split("topic_id", " ", 2)[1].alias("topic_id")
    named = (F.col("doc_ord").cast("string").alias("doc_no"), "score", "rank")
    return {"bm25": base.select("topic_id", *named)} | {k: fed.where(kind == k).select(topic, *named) for k in ("rm3", "rm3exp")}


def tokenize(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(raw_tokens(F.col("text"))).alias("p", "token")).select("doc_id", F.col("p").cast("long").alias("pos"), "token")


def normalize_terms(spark, d):
    return index_of(spark, d).term_counts()


def doc_lengths(spark, d):
    return index_of(spark, d).lengths().select("doc_ord", F.col("doc_len").cast("long").alias("doc_len"))


def postings(spark, d):
    return index_of(spark, d).all_postings().select("term", "doc_ord", F.col("tf").cast("long").alias("tf"))


def vocab_df(spark, d):
    index = index_of(spark, d)
    counts = index.term_counts(distinct=True).withColumnRenamed("n", "df")
    return counts.crossJoin(index.statistics()).select("term", "df", F.round(F.ln(F.col("n_docs") / F.col("df")), 9).alias("idf"))


def collection_stats(spark, d):
    return index_of(spark, d).statistics().select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def topics_parse(spark, d):
    return topics_of(spark, d).select("topic_id", F.posexplode("words").alias("p", "term")).select("topic_id", F.col("p").cast("long").alias("pos"), "term")


def bm25_top1000(spark, d):
    return _published(sparse.top(sparse.rank_bm25(index_of(spark, d), sparse.query_terms(topics_of(spark, d)), most=1000), 1000))


def bm25_params(spark, d):
    ranking = replace(RANKING, k1=1.2, b=0.75)
    return _published(sparse.top(sparse.rank_bm25(index_of(spark, d), sparse.query_terms(topics_of(spark, d)), ranking, 1000), 1000))


def prf_terms(spark, d):
    index, topics = index_of(spark, d), topics_of(spark, d)
    terms = sparse.query_terms(topics)
    return sparse.expanded(index, topics, terms).select("topic_id", "term", F.round("weight", 6).alias("weight"))


def rm3_run(spark, d):
    return _published(sparse.top(sparse.rank_feedback(index_of(spark, d), topics_of(spark, d), most=1000), 1000))


def rm3_expansion_only(spark, d):
    ranking = replace(RANKING, expansion_only=True)
    return _published(sparse.top(sparse.rank_feedback(index_of(spark, d), topics_of(spark, d), ranking, most=1000), 1000))


def passage_scores(spark, d):
    index, terms = index_of(spark, d), sparse.query_terms(topics_of(spark, d))
    first = sparse.top(sparse.rank_bm25(index, terms, most=RANKING.rerank_docs), RANKING.rerank_docs)
    return sparse.passage_scores(index, terms, first).select("topic_id", "doc_ord", F.round("passage", 6).alias("passage"))


def passage_rerank(spark, d):
    index, terms = index_of(spark, d), sparse.query_terms(topics_of(spark, d))
    return _published(sparse.rerank_passages(index, terms, sparse.rank_bm25(index, terms, most=1000)))


def sparse_default(spark, d):
    return _published(sparse.search(index_of(spark, d), topics_of(spark, d)))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_ord"), "embedding")


def dense_topk(spark, d):
    vectors = _vectors(spark, d)
    asked = vectors.where("doc_ord < 10").select(F.col("doc_ord").cast("string").alias("topic_id"), "embedding")
    return _published(nearest(vectors, asked, 100))


def dense_every_20th(spark, d):
    """The whole query set: every row whose id is divisible by 20, in blocks of queries."""
    vectors = _vectors(spark, d)
    asked = vectors.where("doc_ord % 20 = 0").select(F.col("doc_ord").cast("string").alias("topic_id"), "embedding")
    return _published(nearest(vectors, asked, 1000, least=DENSE_BLOCK))


def l2_normalize(spark, d):
    made = table(spark, d, "embeddings").select("vec_id", F.posexplode(unit(F.col("embedding"))).alias("p", "x"))
    return made.select("vec_id", F.col("p").cast("long").alias("pos"), F.round("x", 9).alias("x"))


def rrf_two(spark, d):
    return _named(fusion.fuse(_runs(spark, d), TWO), 9)


def rrf_tri(spark, d):
    return _named(fusion.fuse(_runs(spark, d), TRI), 9)


def rrf_tail(spark, d):
    return _named(fusion.fuse_with_tail(_runs(spark, d), SHALLOW), 9)


def fusion_ablations(spark, d):
    made = fusion.ablations(_runs(spark, d), TRI)
    out = None
    for name, run in sorted(made.items()):
        part = _named(run, 8 if name != "bm25" else 6).where("rank <= 100").withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def fusion_ablations_whole(spark, d):
    """The ablations over whole runs, the completed tail included."""
    made = fusion.ablations(_runs(spark, d), TRI)
    parts = [_named(run, 8 if name != "bm25" else 6).withColumn("name", F.lit(name)) for name, run in sorted(made.items())]
    return reduce(DataFrame.unionByName, parts)


def rewrite_eligible(spark, d):
    return topics_of(spark, d).select("topic_id", neural.eligible(F.col("text")).alias("eligible"))


def _answers(spark, d):
    items = table(spark, d, "benchmark")
    return items.select(F.col("item_id").cast("string").alias("topic_id"), F.array_join(F.slice(raw_tokens(F.col("text")), 2, 9), " ").alias("answer"))


def rewrite_normalize(spark, d):
    joined = topics_of(spark, d).join(_answers(spark, d), "topic_id")
    return joined.select("topic_id", neural.normalised_rewrite(F.col("text"), F.col("answer")).alias("rewrite"))


def _mono(spark, d):
    run = _runs(spark, d)["bm25"]
    stub = (F.col("topic_id").cast("long") * 31 + F.col("doc_no").cast("long") * 17) % 101
    scores = run.where("rank <= 85").select("topic_id", "doc_no", stub.alias("llm_score"))
    return neural.mono_rerank(run, scores)


def mono_rerank(spark, d):
    return _mono(spark, d).select("topic_id", "doc_no", F.col("rank").cast("long").alias("rank"), "llm_score", "final_score")


def duo_rerank(spark, d):
    mono = _mono(spark, d)
    pairs = neural.pairs_to_compare(mono)
    winner = F.when((F.col("doc_a").cast("long") * 7 + F.col("doc_b").cast("long") * 13 + F.col("topic_id").cast("long")) % 3 < 2, "A").otherwise("B")
    made = neural.duo_rerank(mono, pairs.withColumn("winner", winner))
    return made.select("topic_id", "doc_no", F.col("rank").cast("long").alias("rank"), F.col("wins").cast("long").alias("wins"), "final_score")


def llm_parse(spark, d):
    """Responses in each layout, made from document ids, parsed back."""
    i = F.col("doc_id")
    number = (i * 37 % 131).cast("string")
    body = F.when(i % 4 == 0, F.concat(F.lit('{"output_text": "{\\"score\\": '), number, F.lit('}"}'))).when(
        i % 4 == 1, F.concat(F.lit('{"output": [{"content": [{"text": "about '), number, F.lit(' of 100"}]}]}'))
    ).when(i % 4 == 2, F.concat(F.lit('{"choices": [{"message": {"content": "-'), number, F.lit('"}}]}'))).otherwise(F.lit('{"status": "incomplete"}'))
    texts = table(spark, d, "documents").select("doc_id", neural.response_text(body).alias("text"))
    won = F.when(i % 3 == 0, F.lit('{"winner": "B"}')).when(i % 3 == 1, F.lit(" a is better")).otherwise(F.lit("neither"))
    return texts.select("doc_id", "text", neural.parsed_score(F.col("text")).cast("long").alias("score"), neural.parsed_winner(won).alias("winner"))


def llm_usage_cost(spark, d):
    docs = table(spark, d, "documents")
    requests = docs.select(F.col("text").alias("prompt"), F.lit("relevant at 42 of 100").alias("response"), (F.col("doc_id") % 4 == 0).alias("hit"))
    got = neural.usage(requests, "gpt-5-mini")
    return got.select("calls", "hits", "misses", F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), F.round("cost", 9).alias("cost"))


def doc_text_prefix(spark, d):
    return text_prefix(index_of(spark, d).forward)


def _measures(spark, d):
    run = printed(_runs(spark, d)["bm25"])
    return evaluate.per_topic(run, **_judgments(spark, d))


def _measure(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, d):
        return _measures(spark, d).select("topic_id", *[F.round(f"`{n}`", 9).alias(n.replace(".", "_")) for n in names])

    return query


def eval_gm_map(spark, d):
    return evaluate.overall(_measures(spark, d)).select(F.round("map", 9).alias("map"), F.round("gm_map", 9).alias("gm_map"), F.round("recall", 9).alias("recall"))


#: Up to so many judged documents are sent to every executor, so that a grid's rows need not move to meet them.
BROADCAST_JUDGED = 500_000


def _broadcast_judgments(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {k: F.broadcast(v) if v.count() <= BROADCAST_JUDGED else v for k, v in _judgments(spark, sf_dir).items()}


def bm25_grid(spark, d):
    index, terms = index_of(spark, d), sparse.query_terms(topics_of(spark, d))
    cells = tuning.grid(spark, k1=tuning.BM25_K1, b=tuning.BM25_B)
    run = settled(tuning.bm25_grid(index, terms, cells), "bm25_grid")
    named = run.select("k1", "b", "topic_id", F.col("doc_ord").cast("string").alias("doc_no"), "score")
    return _cells_measured(spark, d, evaluate.marked(named, **_broadcast_judgments(spark, d)), ["k1", "b"], cells, named)


def passage_grid(spark, d):
    index, terms = index_of(spark, d), sparse.query_terms(topics_of(spark, d))
    run = tuning.passage_grid(index, terms, sparse.rank_bm25(index, terms, most=tuning.RESULTS), GRID_DOCS, GRID_WINDOWS, GRID_WEIGHTS)
    return run.where("rank <= 100").select("docs", "window", "weight", "topic_id", "doc_ord", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def fusion_simplex(spark, d):
    return tuning.simplex(spark).select(*[F.round(w, 6).alias(w) for w in ("w1", "w2", "w3")])


def fusion_grid(spark, d):
    runs = _runs(spark, d)
    cells = tuning.simplex(spark, 0.25, 0.25, 0.75)
    made = tuning.fusion_grid([runs[k] for k in ("bm25", "rm3", "rm3exp")], cells)
    return made.where("rank <= 50").select("w1", "w2", "w3", "topic_id", "doc_no", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


def _cells_measured(spark, d, run: DataFrame, cell: list[str], cells: DataFrame, base: DataFrame) -> DataFrame:
    """Measures of each of ``cells`` from a run that is marked; none if ``base``, which all of them rank, has no row."""
    some = cells.crossJoin(base.select(F.lit(1).alias("__some")).limit(1)).select(*cell)
    rows = printed(run.select(*cell, "topic_id", "doc_no", "score", "hit", "non"))
    topics = evaluate.per_topic(rows, by=cell, cells=some, **_judgments(spark, d))
    return evaluate.overall(topics, cell).select(*[F.round(c, 6).alias(c) if c.startswith("w") and c != "window" else c for c in cell], *[F.round(c, 9).alias(c) for c in ("map", "Rprec", "P_10", "bpref", "recip_rank")])


def passage_grid_measures(spark, d):
    """Measures of every default cell of (docs, window, weight) over whole runs."""
    index, terms = index_of(spark, d), sparse.query_terms(topics_of(spark, d))
    axes = {"docs": tuning.RERANK_DOCS, "windows": tuning.RERANK_WINDOWS, "weights": tuning.RERANK_WEIGHTS}
    base = settled(sparse.top(sparse.rank_bm25(index, terms, most=tuning.RESULTS), tuning.RESULTS).drop("rank"), "passage_base")
    run = tuning.passage_grid(index, terms, base, *axes.values(), told=lambda rows: evaluate.marked(rows.withColumn("doc_no", F.col("doc_ord").cast("string")), **_judgments(spark, d)))
    return _cells_measured(spark, d, run, ["docs", "window", "weight"], tuning.grid(spark, docs=axes["docs"], window=axes["windows"], weight=axes["weights"]), base)


def fusion_grid_measures(spark, d):
    """Measures of every cell of the default simplex over whole fused runs."""
    runs, cells = _runs(spark, d), tuning.simplex(spark)
    run = tuning.fusion_grid([runs[k] for k in ("bm25", "rm3", "rm3exp")], cells, told=lambda rows: evaluate.marked(rows, **_judgments(spark, d)))
    return _cells_measured(spark, d, run, ["w1", "w2", "w3"], cells, reduce(DataFrame.unionByName, runs.values()))


def page_fields(spark, d):
    docs = table(spark, d, "pages").select(F.col("page_id").alias("doc_ord"), F.col("html").alias("text"))
    made = weighted_tokens(docs, PAGE_FIELDS).groupBy("doc_ord", "term").agg(F.sum("weight").cast("long").alias("tf"))
    return made.select(F.col("doc_ord").alias("page_id"), "term", "tf")


def branch_report(spark, d):
    rows = spark.createDataFrame(list(BRANCHES), "branch string, stamp string, map double, num_rel long, num_rel_ret long")
    made = report.branch_report(rows.withColumn("timestamp", F.to_timestamp("stamp", "yyyyMMdd-HHmmss")))
    names = ("recall", "map_delta_vs_previous", "map_delta_vs_original", "map_change_percent")
    return made.select("branch", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("place").cast("long").alias("place"), *[F.round(n, 9).alias(n) for n in names])


def timing_summary(spark, d):
    times = table(spark, d, "events").select(F.col("event_type").alias("label"), F.col("value").alias("seconds"))
    return report.timing_summary(times)


def estimated_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", token_estimate(F.col("text")).cast("long").alias("tokens"))


def body_term_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("lang", F.size(body_terms(F.col("text"))).alias("n")).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("terms"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize, normalize_terms, doc_lengths, postings, vocab_df, collection_stats, topics_parse, bm25_top1000, bm25_params, prf_terms,
        rm3_run, rm3_expansion_only, passage_scores, passage_rerank, sparse_default, dense_topk, dense_every_20th, l2_normalize, rrf_two, rrf_tri, rrf_tail,
        fusion_ablations, fusion_ablations_whole, rewrite_eligible, rewrite_normalize, mono_rerank, duo_rerank, llm_parse, llm_usage_cost, doc_text_prefix, eval_gm_map,
        bm25_grid, passage_grid, fusion_simplex, fusion_grid, passage_grid_measures, fusion_grid_measures, page_fields, branch_report, timing_summary, estimated_tokens, body_term_counts,
    )
} | {
    "eval_map": _measure("map"),
    "eval_rprec": _measure("Rprec"),
    "eval_bpref": _measure("bpref"),
    "eval_recip_rank": _measure("recip_rank"),
    "eval_iprec": _measure(*[f"iprec_at_recall_{x:.2f}" for x in evaluate.LEVELS]),
    "eval_pk": _measure(*[f"P_{k}" for k in evaluate.CUTS]),
    "eval_counts": _measure("num_ret", "num_rel", "num_rel_ret"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
