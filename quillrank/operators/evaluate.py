"""Standard ranked-retrieval measures of a run against judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
LEVELS = tuple(i / 10 for i in range(11))
DEPTH = 1000


def judged_once(qrels: DataFrame) -> DataFrame:
    """``topic_id, doc_no, hit, non`` of each judged document: relevant, or judged not to be."""
    told = qrels.groupBy("topic_id", "doc_no").agg(F.max((F.col("rel") > 0).cast("int")).alias("hit"))
    return told.withColumn("non", 1 - F.col("hit"))


def judged_topics(qrels: DataFrame, poor: DataFrame | None = None) -> DataFrame:
    """``topic_id, num_rel, num_nonrel`` of topics with a relevant document."""
    told = judged_once(qrels)
    if poor is None:
        return told.groupBy("topic_id").agg(F.sum("hit").alias("num_rel"), F.sum("non").alias("num_nonrel")).where("num_rel > 0")
    listed = poor.select("doc_no").distinct()
    both = told.join(listed.withColumn("poor", F.lit(1)), "doc_no", "left")
    counts = both.groupBy("topic_id").agg(F.sum("hit").alias("num_rel"), F.sum(F.when(F.col("poor").isNull(), F.col("non")).otherwise(-F.col("hit"))).alias("more"))
    total = listed.agg(F.count("*").alias("n_poor"))
    return counts.where("num_rel > 0").crossJoin(F.broadcast(total)).select("topic_id", "num_rel", (F.col("n_poor") + F.col("more")).alias("num_nonrel"))


def marked(run: DataFrame, qrels: DataFrame, poor: DataFrame | None = None) -> DataFrame:
    """A run's rows with ``hit``, ``non`` (0 where not judged)."""
    run = run.join(judged_once(qrels), ["topic_id", "doc_no"], "left")
    non = F.coalesce("non", F.lit(0))
    if poor is not None:
        run = run.join(poor.select("doc_no").distinct().withColumn("poor", F.lit(1)), "doc_no", "left")
        non = F.coalesce("non", "poor", F.lit(0))
    return run.withColumn("hit", F.coalesce("hit", F.lit(0))).withColumn("non", non).drop("poor")


def per_topic(run: DataFrame, qrels: DataFrame, by: list[str] | None = None, poor: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Measures of every judged topic, one row each; topics not retrieved score 0.

    ``run(topic_id, doc_no, score)`` is ordered by score, then doc_no, both
    descending, and cut at 1000; its own ranks are ignored. ``qrels(topic_id,
    doc_no, rel)``: above 0 relevant, 0 judged not relevant; each document of
    a topic counts once. ``poor(doc_no)`` are judged not relevant for every
    topic that ``qrels`` doesn't judge them for: they are counted, not listed
    with every topic. ``by`` are further key columns of the run (such as a
    parameter cell), ``cells`` their values where known. Topics without a
    relevant document are left out. A run that is ``marked`` is not joined
    again.
    """
    by = by or []
    keys = [*by, "topic_id"]
    judged = judged_topics(qrels, poor)
    if not {"hit", "non"} <= set(run.columns):
        run = marked(run, qrels, poor)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("doc_no"))  # one order for all: one sort
    ahead = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = run.select(*keys, "score", "doc_no", "hit", "non").withColumns({"rank": F.row_number().over(order), "found": F.sum("hit").over(ahead), "above": F.sum("non").over(ahead)})
    hits = placed.where(F.col("rank") <= DEPTH).join(F.broadcast(judged), "topic_id").withColumn("precision", F.col("found") / F.col("rank"))
    small = F.least("num_rel", "num_nonrel")
    pref = F.when(F.col("above") == 0, F.lit(1.0)).otherwise(1.0 - F.least("above", "num_rel") / F.when(small > 0, small).otherwise(F.lit(1)))
    hit = F.col("hit") == 1
    total = [
        F.count("*").alias("num_ret"),
        F.sum("hit").alias("num_rel_ret"),
        F.sum(F.when(hit, F.col("precision")).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.when(F.col("rank") <= F.col("num_rel"), F.col("hit")).otherwise(0)).alias("r_hits"),
        F.sum(F.when(hit, pref).otherwise(0.0)).alias("pref_sum"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        *[F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"hits_{k}") for k in CUTS],
        *[F.max(F.when(F.col("found") >= F.ceil(F.lit(level) * F.col("num_rel") - 1e-9), F.col("precision"))).alias(f"iprec_{int(level * 10)}") for level in LEVELS],
    ]
    measured = hits.groupBy(*keys).agg(*total)
    if by:
        cells = run.select(*by).distinct() if cells is None else cells
        judged = F.broadcast(cells).crossJoin(judged)
    full = judged.join(measured, keys, "left").fillna(0)
    named = {
        "map": F.col("ap_sum") / F.col("num_rel"), "Rprec": F.col("r_hits") / F.col("num_rel"), "bpref": F.col("pref_sum") / F.col("num_rel"),
        "recip_rank": F.when(F.col("first_hit") > 0, 1.0 / F.when(F.col("first_hit") > 0, F.col("first_hit")).otherwise(1)).otherwise(0.0),
    } | {f"P_{k}": F.col(f"hits_{k}") / F.lit(float(k)) for k in CUTS} | {f"iprec_at_recall_{level:.2f}": F.col(f"iprec_{int(level * 10)}") for level in LEVELS}
    return full.select(*keys, *[F.col(c).cast("double") for c in ("num_ret", "num_rel", "num_rel_ret")], *[e.cast("double").alias(f"`{n}`".strip("`")) for n, e in named.items()])


def overall(topics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums, means and the geometric mean over all topics, one row (per ``by``)."""
    sums = [F.sum(c).cast("double").alias(c) for c in ("num_ret", "num_rel", "num_rel_ret")]
    skip = {*(by or []), "topic_id", "num_ret", "num_rel", "num_rel_ret"}
    means = [F.avg(f"`{c}`").alias(c) for c in topics.columns if c not in skip]
    gm = F.exp(F.avg(F.ln(F.greatest("map", F.lit(1e-5))))).alias("gm_map")
    recall = F.coalesce(F.try_divide(F.sum("num_rel_ret"), F.sum("num_rel")), F.lit(0.0)).alias("recall")
    return topics.groupBy(*(by or [])).agg(F.count("*").cast("double").alias("num_q"), *sums, gm, recall, *means)


def long_form(summary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``metric``, ``scope`` (all), ``value`` rows of an overall summary."""
    keys = by or []
    return summary.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`") for c in summary.columns if c not in keys], "metric", "value").withColumn("scope", F.lit("all"))
