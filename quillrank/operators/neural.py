"""Model-backed stages: rewriting, scoring, comparing, caching, accounting.

Models are Python callables over batches of texts; answers are cached by the
hash of their request in an ordinary table, so a rerun calls for misses only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Models
from ..functions.text import model_terms, token_estimate, whitespace_parts

# Dollars per million input and output tokens.
PRICES = {"gpt-5-mini": (0.25, 2.0), "gpt-5.1": (1.25, 10.0)}
_RESPONSE = "output_text string, output array<struct<content: array<struct<text: string>>>>, choices array<struct<message: struct<content: string>>>, status string"


def eligible(text: Column, most: int = 3) -> Column:
    """Whether a topic has 1 to ``most`` terms and may be rewritten."""
    return F.size(model_terms(text)).between(1, most)


def normalised_rewrite(query: Column, answer: Column, most: int = 8) -> Column:
    """The terms of a model's answer that replace a query, joined by spaces.

    The answer's first ``most`` distinct terms: those of the query stay, of
    new ones the first three (one if the query has several terms). Empty if
    nothing is left or nothing changes.
    """
    asked = model_terms(query)
    told = F.slice(F.array_distinct(model_terms(answer)), 1, most)
    allowed = F.when(F.size(asked) <= 1, 3).otherwise(1)
    new = F.filter(told, lambda t: ~F.array_contains(asked, t))
    kept = F.filter(told, lambda t: F.array_contains(asked, t) | (F.array_position(new, t) <= allowed) & F.array_contains(new, t))
    return F.when(kept == asked, F.lit("")).otherwise(F.array_join(kept, " "))


def response_text(response: Column) -> Column:
    """The text of a model response in any of its three layouts; null if none."""
    r = F.from_json(response, _RESPONSE)
    direct = F.trim(r["output_text"])
    nested = F.flatten(F.transform(r["output"], lambda o: F.coalesce(o["content"]["text"], F.array().cast("array<string>"))))
    chosen = F.filter(F.transform(r["choices"], lambda c: c["message"]["content"]), lambda t: F.trim(t) != "")
    return F.coalesce(F.when(direct != "", direct), _joined(nested), _joined(chosen))


def _joined(texts: Column) -> Column:
    there = F.filter(texts, lambda t: t.isNotNull())
    return F.when(F.size(there) > 0, F.trim(F.array_join(there, "\n")))


def parsed_score(text: Column) -> Column:
    """0 to 100: the JSON field ``score``, else the first integer; null if none."""
    field = F.try_element_at(F.from_json(text, "map<string,string>"), F.lit("score")).try_cast("double").cast("int")
    found = F.regexp_extract(text, r"-?\d+", 0)
    number = F.coalesce(field, F.when(found != "", found.try_cast("int")))
    return F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), number)))


def parsed_winner(text: Column) -> Column:
    """A or B: the JSON field ``winner``, else the leading letter; null if none."""
    field = F.try_element_at(F.from_json(text, "map<string,string>"), F.lit("winner"))
    lead = F.substring(F.upper(F.trim(text)), 1, 1)
    return F.coalesce(F.when(field.isin("A", "B"), field), F.when(lead.isin("A", "B"), lead))


def request_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def answered(requests: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]] | None, batch: int = 64) -> DataFrame:
    """``requests(key, prompt, ...)`` with ``response`` and ``hit``.

    ``cache(key, response)`` answers first; ``model`` gets each distinct miss
    once. Without a model any miss raises when it is read.
    """
    known = requests.join(cache.select("key", "response"), "key", "left").withColumn("hit", F.col("response").isNotNull())
    hits = known.where("hit")
    misses = known.where("not hit").drop("response")
    if model is None:
        missing = F.raise_error(F.concat(F.lit("not in the response cache: "), F.col("key")))
        return hits.unionByName(misses.withColumn("response", missing.cast("string")))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield part.assign(response=model(part["prompt"].tolist()))[["key", "response"]]

    fresh = misses.groupBy("key").agg(F.first("prompt").alias("prompt")).select("key", "prompt").mapInPandas(call, "key string, response string")
    return hits.unionByName(misses.join(fresh, "key"))


class Retryable(Exception):
    """A model's failure with a ``code``; those in ``RETRYABLE`` may pass."""

    def __init__(self, code: int, text: str = ""):
        super().__init__(f"{code}: {text}")
        self.code, self.text = code, text


# Codes that are tried again, as is a 400 about unparsed JSON.
RETRYABLE = (408, 409, 429, 500, 502, 503, 504)
UNPARSED = "could not parse the JSON"


def patient(model: Callable[[list[str]], list], tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list]:
    """``model`` called up to ``tries`` times, waiting twice as long each time."""

    def call(texts: list[str]) -> list:
        for k in range(tries):
            try:
                return model(texts)
            except Retryable as error:
                passing = error.code in RETRYABLE or (error.code == 400 and UNPARSED.lower() in error.text.lower())
                if not passing or k == tries - 1:
                    raise
                sleep(wait * 2**k)
        raise ValueError("tries must be positive")

    return call


def in_input_order(indexed: list[tuple[int, object]], n: int) -> list:
    """Answers that carry their input's number, in the inputs' order; raises if one lacks."""
    found = dict(indexed)
    if set(found) != set(range(n)):
        raise ValueError("the model did not answer every input")
    return [found[i] for i in range(n)]


def scoring_requests(run: DataFrame, topics: DataFrame, texts: DataFrame, model: str, docs: int = 85) -> DataFrame:
    """``topic_id, doc_no, key, prompt`` for a run's first ``docs``.

    ``topics(topic_id, text)``: a missing text becomes the topic's id;
    ``texts(doc_no, doc_text)``: a missing one becomes empty.
    """
    asked = _described(run.where(F.col("rank") <= docs).select("topic_id", "doc_no"), topics, texts, ["doc_no"])
    prompt = F.concat(F.lit("How relevant is the passage to the query? Answer with JSON {\"score\": 0 to 100}.\nQuery: "), F.col("query"), F.lit("\nPassage: "), F.col("doc_no_text"))
    return asked.withColumn("prompt", prompt).withColumn("key", request_key(F.lit(model), F.lit("score"), F.col("prompt"))).select("topic_id", "doc_no", "key", "prompt")


def comparing_requests(run: DataFrame, topics: DataFrame, texts: DataFrame, model: str, docs: int = 10) -> DataFrame:
    """``topic_id, doc_a, doc_b, key, prompt`` for each pair of a run's first ``docs``."""
    asked = _described(pairs_to_compare(run, docs), topics, texts, ["doc_a", "doc_b"])
    prompt = F.concat(F.lit("Which passage answers the query better? Answer with JSON {\"winner\": \"A\" or \"B\"}.\nQuery: "), F.col("query"), F.lit("\nA: "), F.col("doc_a_text"), F.lit("\nB: "), F.col("doc_b_text"))
    return asked.withColumn("prompt", prompt).withColumn("key", request_key(F.lit(model), F.lit("compare"), F.col("prompt"))).select("topic_id", "doc_a", "doc_b", "key", "prompt")


def _described(pairs: DataFrame, topics: DataFrame, texts: DataFrame, names: list[str]) -> DataFrame:
    out = pairs.join(topics.select("topic_id", F.col("text").alias("query")), "topic_id", "left").withColumn("query", F.coalesce(F.when(F.col("query") != "", F.col("query")), F.col("topic_id")))
    for name in names:
        told = texts.select(F.col("doc_no").alias(name), F.col("doc_text").alias(f"{name}_text"))
        out = out.join(told, name, "left").withColumn(f"{name}_text", F.coalesce(f"{name}_text", F.lit("")))
    return out


def scored(requests: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]] | None) -> DataFrame:
    """``topic_id, doc_no, llm_score`` (0 where the answer holds none), through the cache."""
    got = answered(requests, cache, model)
    return got.select("topic_id", "doc_no", F.coalesce(parsed_score(response_text(F.col("response"))), F.lit(0)).alias("llm_score"))


def judged(requests: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]] | None) -> DataFrame:
    """``topic_id, doc_a, doc_b, winner`` (A where the answer names none), through the cache."""
    got = answered(requests, cache, model)
    return got.select("topic_id", "doc_a", "doc_b", F.coalesce(parsed_winner(response_text(F.col("response"))), F.lit("A")).alias("winner"))


def rerank(run: DataFrame, topics: DataFrame, texts: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]] | None, limits: Models = Models(), name: str = "gpt-5-mini") -> DataFrame:
    """A run reranked by scores and, in mode ``mono_duo``, by pairwise wins."""
    if limits.mode == "off":
        return run
    mono = mono_rerank(run, scored(scoring_requests(run, topics, texts, name, limits.mono_docs), cache, model), limits.mono_docs)
    if limits.mode == "mono":
        return mono
    return duo_rerank(mono, judged(comparing_requests(mono, topics, texts, name, limits.duo_docs), cache, model), limits.duo_docs)


def rewriting_requests(topics: DataFrame, model: str, most: int = 3) -> DataFrame:
    """``topic_id, key, prompt`` of the topics that may be rewritten."""
    prompt = F.concat(F.lit("Expand this short search query with a few closely related terms. Answer with the terms only.\nQuery: "), F.col("text"))
    asked = topics.where(eligible(F.col("text"), most)).withColumn("prompt", prompt)
    return asked.select("topic_id", request_key(F.lit(model), F.lit("rewrite"), F.col("prompt")).alias("key"), "prompt")


def rewritten(topics: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]] | None, name: str = "gpt-5-mini", query_terms: int = 3, output_terms: int = 8) -> DataFrame:
    """``topic_id, text`` of the topics that a model rewrites, through the cache."""
    got = answered(rewriting_requests(topics, name, query_terms), cache, model)
    return rewritten_topics(topics, got.select("topic_id", response_text(F.col("response")).alias("answer")), query_terms, output_terms)


def checked_vectors(vectors: DataFrame, docs: DataFrame, dimensions: int) -> DataFrame:
    """``vectors(doc_ord, embedding)``; raises unless each of ``docs(doc_ord)`` has one of that length."""
    wrong = vectors.where(F.col("embedding").isNull() | (F.size("embedding") != dimensions)).count()
    lacking = docs.select("doc_ord").join(vectors.select("doc_ord"), "doc_ord", "left_anti").count()
    beyond = vectors.count() - docs.count() + lacking
    if wrong or lacking or beyond:
        raise ValueError(f"vectors: {wrong} of another length than {dimensions}, {lacking} documents without one, {beyond} beyond the documents")
    return vectors


def embedded(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """``doc_ord``, ``embedding`` (unit length; zeros for an empty text) of ``texts(doc_ord, doc_text)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                made = model(part["doc_text"].tolist())
                vectors = []
                for text, v in zip(part["doc_text"], made, strict=True):
                    size = sum(x * x for x in v) ** 0.5 if text else 0.0
                    vectors.append([x / size for x in v] if size else [0.0] * len(v))
                yield pd.DataFrame({"doc_ord": part["doc_ord"], "embedding": vectors})

    return texts.select("doc_ord", "doc_text").mapInPandas(run, "doc_ord long, embedding array<float>")


def add_missing_embeddings(texts: DataFrame, done: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """Embeddings of the documents that ``done`` lacks, to be appended to it."""
    return embedded(texts.join(done.select("doc_ord"), "doc_ord", "left_anti"), model, batch)


def mono_rerank(run: DataFrame, scores: DataFrame, docs: int = 85) -> DataFrame:
    """A run's first ``docs`` reordered by ``scores(topic_id, doc_no, llm_score)``.

    Ties by the run's score at nine decimals, then rank; the rest keeps its order. Adds
    ``llm_score`` (null below), new ``rank`` and ``final_score`` (n - rank + 1).
    """
    judged = run.where(F.col("rank") <= docs).select("topic_id", "doc_no").join(scores, ["topic_id", "doc_no"])
    joined = run.withColumnRenamed("rank", "source_rank").join(judged, ["topic_id", "doc_no"], "left")
    return _final(joined, [F.col("source_rank") > docs, F.desc("llm_score"), F.round("score", 9).desc(), F.col("source_rank")])


def pairs_to_compare(run: DataFrame, docs: int = 10) -> DataFrame:
    """``topic_id, doc_a, doc_b`` of the first ``docs``, each pair once, a ahead of b."""
    first = run.where(F.col("rank") <= docs)
    a = first.select("topic_id", F.col("doc_no").alias("doc_a"), F.col("rank").alias("rank_a"))
    b = first.select("topic_id", F.col("doc_no").alias("doc_b"), F.col("rank").alias("rank_b"))
    return a.join(b, "topic_id").where("rank_a < rank_b").drop("rank_a", "rank_b")


def duo_rerank(mono: DataFrame, winners: DataFrame, docs: int = 10) -> DataFrame:
    """A mono-reranked run's first ``docs`` reordered by wins.

    ``winners(topic_id, doc_a, doc_b, winner)``; ties by llm_score, the
    source's score, then its rank. The rest keeps its order.
    """
    won = winners.select("topic_id", F.when(F.col("winner") == "A", F.col("doc_a")).otherwise(F.col("doc_b")).alias("doc_no"))
    wins = won.groupBy("topic_id", "doc_no").agg(F.count("*").alias("won"))
    joined = mono.withColumnRenamed("rank", "mono_rank").drop("final_score").join(wins, ["topic_id", "doc_no"], "left")
    inside = F.col("mono_rank") <= docs
    counted = joined.withColumn("wins", F.when(inside, F.coalesce("won", F.lit(0)))).drop("won")
    return _final(counted, [~inside, F.desc("wins"), F.when(inside, -F.col("llm_score")), F.when(inside, -F.round("score", 9)), F.when(inside, F.col("source_rank")), F.col("mono_rank")])


def _final(run: DataFrame, order: list[Column]) -> DataFrame:
    ranked = run.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(*order)))
    return ranked.withColumn("final_score", (F.count("*").over(Window.partitionBy("topic_id")) - F.col("rank") + 1).cast("double"))


def usage(requests: DataFrame, model: str, duo_model: str | None = None) -> DataFrame:
    """One row: calls, hits, misses, estimated tokens and cost of ``requests(prompt, response, hit)``.

    With a pairwise model that differs from ``model`` no one price holds and the cost is 0.
    """
    price_in, price_out = PRICES.get(model, (0.0, 0.0)) if duo_model in (None, model) else (0.0, 0.0)
    totals = requests.agg(
        F.count("*").alias("calls"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.coalesce(F.sum(token_estimate(F.col("prompt"))), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(token_estimate(F.col("response"))), F.lit(0)).alias("output_tokens"),
    )
    return totals.withColumn("cost", F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out)


def rewritten_topics(topics: DataFrame, answers: DataFrame, query_terms: int = 3, output_terms: int = 8) -> DataFrame:
    """``topic_id``, ``text`` of the eligible topics whose rewrite isn't empty."""
    joined = topics.where(eligible(F.col("text"), query_terms)).join(answers.select("topic_id", "answer"), "topic_id")
    made = joined.select("topic_id", normalised_rewrite(F.col("text"), F.col("answer"), output_terms).alias("text"))
    return made.where("text <> ''")


def words_of(topics: DataFrame) -> DataFrame:
    """``topic_id``, ``words`` of rewritten topics, ready to search."""
    return topics.select("topic_id", whitespace_parts(F.col("text")).alias("words"))
