"""The index: forward documents, and postings derived from or stored beside them."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scan

#: Terms whose frequencies an index remembers.
MOST_SEEN = 500_000


@dataclass
class Index:
    """``forward(doc_ord, doc_no, terms, doc_len)``, optionally ``postings(term, doc_ord, tf, doc_len)``.

    ``terms`` is the ordered term stream, ``doc_len`` the weighted length.
    ``texts(doc_ord, text)`` are what an index that isn't saved is made of:
    each question is one scan of them, and no table of all terms is shuffled.
    """

    forward: DataFrame
    postings: DataFrame | None = None
    vocab: DataFrame | None = None
    known: tuple[int, float] | None = None
    seen: dict[str, int] = field(default_factory=dict)
    texts: DataFrame | None = None

    def scanned(self, kernel, schema: str | StructType) -> DataFrame:
        """What ``kernel`` makes of the texts."""
        return self.texts.mapInArrow(kernel, schema)

    def _survey(self, names: list[str]) -> DataFrame:
        """``term, n``: documents that hold each name; all documents under null, all their terms under ""."""
        told = self.texts.sparkSession.sparkContext.broadcast(names)
        return self.scanned(scan.survey(lambda: told.value), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    def _surveyed(self, names: list[str]) -> dict[str, int]:
        """The same read, which also tells the totals."""
        told = self._survey(names).toArrow()
        rows = dict(zip(told.column("term").to_pylist(), told.column("n").to_pylist(), strict=True))
        n_docs, words = rows.pop(None, 0), rows.pop("", 0)
        self.known = (n_docs, words / n_docs if n_docs else 0.0)
        return rows

    def totals(self) -> tuple[int, float]:
        """Number of documents and their mean length, read once."""
        if self.known is None and self.texts is not None:
            self._surveyed([])
        if self.known is None:
            row = self.statistics().first()
            self.known = (row["n_docs"], row["avg_len"])
        return self.known

    def statistics(self) -> DataFrame:
        """One row: ``n_docs``, ``avg_len`` (empty documents count)."""
        if self.texts is not None:
            return self.lengths().agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len"))
        return self.forward.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len"))

    def lengths(self) -> DataFrame:
        """``doc_ord``, ``doc_len``."""
        if self.texts is not None:
            return self.texts.select("doc_ord", scan.lengths(F.col("text")).alias("doc_len"))
        return self.forward.select("doc_ord", "doc_len")

    def term_counts(self, distinct: bool = False) -> DataFrame:
        """``term, n``: occurrences of every term of the forward documents, or documents that hold it."""
        if self.texts is not None:
            return self.scanned(scan.term_counts(distinct), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        return self.forward.select(F.explode(F.array_distinct("terms") if distinct else "terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))

    def all_postings(self) -> DataFrame:
        if self.postings is not None:
            return self.postings
        if self.texts is not None:
            kinds = dict(self.texts.dtypes)
            return self.scanned(scan.postings(), f"term string, doc_ord {kinds['doc_ord']}, doc_len int, tf int")
        words = self.forward.select("doc_ord", "doc_len", F.explode("terms").alias("term"))
        return words.groupBy("term", "doc_ord", "doc_len").agg(F.count("*").cast("int").alias("tf"))

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """Postings of the given distinct ``term`` only; others never leave the scan's task."""
        if self.postings is not None:
            return self.postings.join(terms, "term")
        words = self.forward.select("doc_ord", "doc_len", F.explode("terms").alias("term")).join(terms, "term", "left_semi")
        return words.groupBy("term", "doc_ord", "doc_len").agg(F.count("*").cast("int").alias("tf"))

    def postings_in(self, names: list[str]) -> DataFrame:
        """Postings of a bounded list of terms; a saved index reads only what may hold them."""
        if self.postings is not None:
            return self.postings.where(F.col("term").isin(names))
        words = self.forward.select("doc_ord", "doc_len", F.explode(F.filter("terms", lambda t: t.isin(names))).alias("term"))
        return words.groupBy("term", "doc_ord", "doc_len").agg(F.count("*").cast("int").alias("tf"))

    def frequencies_in(self, names: list[str]) -> dict[str, int]:
        """Document frequencies of a bounded list of terms (0: none); recent ones are remembered."""
        new = [n for n in names if n not in self.seen]
        if len(self.seen) + len(new) > MOST_SEEN:
            self.seen.clear()
            new = names
        if new:
            if self.texts is not None:
                self.seen.update(dict.fromkeys(new, 0) | self._surveyed(new))
                return {n: self.seen[n] for n in names}
            if self.vocab is not None:
                found = self.vocab.where(F.col("term").isin(new))
            else:
                words = self.forward.select(F.explode(F.filter(F.array_distinct("terms"), lambda t: t.isin(new))).alias("term"))
                found = words.groupBy("term").agg(F.count("*").alias("df"))
            self.seen.update(dict.fromkeys(new, 0) | {r["term"]: r["df"] for r in found.collect()})
        return {n: self.seen[n] for n in names}

    def with_frequencies(self, rows: DataFrame) -> DataFrame:
        """``rows(term, ...)`` of known terms with ``df``."""
        if self.vocab is not None:
            return rows.join(self.vocab, "term")
        if self.texts is not None:
            listed = rows.select("term").distinct().limit(MOST_SEEN + 1).toArrow().column("term").to_pylist()
            if len(listed) <= MOST_SEEN:
                df = {t: n for t, n in self.frequencies_in(listed).items() if n}  # remembered for what is chosen among them
                return rows.join(rows.sparkSession.createDataFrame(pa.table({"term": pa.array(list(df), pa.string()), "df": pa.array(list(df.values()), pa.int64())})), "term")
        return rows.join(self.frequencies(rows.select("term").distinct()), "term")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """``term``, ``df`` of the given distinct terms that occur."""
        if self.vocab is not None:
            return self.vocab.join(terms, "term")
        words = self.forward.select(F.explode(F.array_distinct("terms")).alias("term")).join(terms, "term", "left_semi")
        return words.groupBy("term").agg(F.count("*").alias("df"))

    def save(self, path: str) -> None:
        """Five tables below ``path``.

        ``forward`` is written first, so texts are tokenised once, and read back
        for the others. Postings are ranged by term and document, so a frequent
        term takes several ranges and a reader skips those without its terms;
        forward documents are ranged by ordinal in files of their own.
        """
        spark = self.forward.sparkSession
        self.forward.write.parquet(f"{path}/forward")
        index = Index(spark.read.parquet(f"{path}/forward"), self.postings)
        index.all_postings().repartitionByRange("term", "doc_ord").sortWithinPartitions("term", "doc_ord").write.parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        stored.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{path}/vocab")
        index.forward.select("doc_ord", "doc_no").write.parquet(f"{path}/documents")
        index.statistics().write.parquet(f"{path}/statistics")


def load_index(spark: SparkSession, path: str) -> Index:
    """A saved index; raises if forward and documents differ in number."""
    forward = spark.read.parquet(f"{path}/forward")
    if forward.count() != spark.read.parquet(f"{path}/documents").count():
        raise ValueError(f"{path}: forward documents and document keys differ in number")
    row = spark.read.parquet(f"{path}/statistics").first()
    return Index(forward, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocab"), (row["n_docs"], row["avg_len"]))


def index_plain(docs: DataFrame) -> Index:
    """Index ``docs(doc_ord, doc_no, text)`` of untagged bodies (null: empty)."""
    forward = docs.select("doc_ord", "doc_no", scan.terms(F.col("text")).alias("terms"))
    return Index(forward.withColumn("doc_len", F.size("terms")), texts=docs.select("doc_ord", "text"))


def index_tagged(docs: DataFrame, tokens: DataFrame) -> Index:
    """Index from ``tokens(doc_ord, pos, term, weight)``; frequencies and lengths are weighted."""
    streams = tokens.groupBy("doc_ord").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("s"), F.sum("weight").cast("int").alias("doc_len"))
    forward = docs.select("doc_ord", "doc_no").join(streams, "doc_ord", "left")
    forward = forward.select("doc_ord", "doc_no", F.coalesce(F.col("s.term"), F.array().cast("array<string>")).alias("terms"), F.coalesce("doc_len", F.lit(0)).alias("doc_len"))
    counts = tokens.groupBy("term", "doc_ord").agg(F.sum("weight").cast("int").alias("tf"))
    postings = counts.join(forward.select("doc_ord", "doc_len"), "doc_ord")
    return Index(forward, postings, postings.groupBy("term").agg(F.count("*").alias("df")))


def text_prefix(forward: DataFrame, words: int = 220) -> DataFrame:
    """``doc_ord``, ``doc_text``: the first words of each document, for models."""
    return forward.select("doc_ord", F.array_join(F.slice("terms", 1, words), " ").alias("doc_text"))
