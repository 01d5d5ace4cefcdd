"""Topics, judgments and runs as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import fixed
from ..functions.text import topic_id, topic_text, topic_words, whitespace_parts


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """``topic_id, text, words, line_no``; blank lines are skipped.

    A leading integer is the id, else the line's number; ``text`` is the rest of the line.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    numbered = lines.where(F.trim("text") != "").withColumn("line_no", F.col("line").cast("long") + 1)
    return numbered.select(topic_id(F.col("text"), F.col("line_no")).alias("topic_id"), topic_text(F.col("text")).alias("text"), topic_words(F.col("text")).alias("words"), "line_no")


def dense_texts(topics: DataFrame) -> DataFrame:
    """``topic_id, text`` to embed; a topic that is an id alone is asked by its id."""
    return topics.select("topic_id", F.when(F.col("text") == "", F.col("topic_id")).otherwise(F.col("text")).alias("text"))


def latest_topics(topics: DataFrame) -> DataFrame:
    """Of repeated ids, the last line."""
    return topics.groupBy("topic_id").agg(F.max_by(F.struct("text", "words", "line_no"), "line_no").alias("t")).select("topic_id", "t.*")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.text(path).select(whitespace_parts(F.col("value")).alias("p")).where(F.size("p") == 4)
    return parts.select(F.col("p")[0].alias("topic_id"), F.col("p")[2].alias("doc_no"), F.col("p")[3].cast("int").alias("rel"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Lines of exactly six fields; others are skipped."""
    parts = spark.read.text(path).select(whitespace_parts(F.col("value")).alias("p")).where(F.size("p") == 6)
    return parts.select(F.col("p")[0].alias("topic_id"), F.col("p")[2].alias("doc_no"), F.col("p")[3].cast("int").alias("rank"), F.col("p")[4].cast("double").alias("score"), F.col("p")[5].alias("run_tag"))


def run_lines(run: DataFrame, tag: str = "quillrank", decimals: int = 4) -> DataFrame:
    """``value``: the run's lines, scores at ``decimals`` places, topics by number, then rank."""
    line = F.concat_ws(" ", "topic_id", F.lit("Q0"), "doc_no", F.col("rank").cast("string"), F.format_string(f"%.{decimals}f", fixed(F.col("score"), decimals)), F.lit(tag))
    return run.orderBy(F.expr("try_cast(topic_id as long)"), "topic_id", "rank").select(line.alias("value"))


def write_run(run: DataFrame, path: str, tag: str = "quillrank", decimals: int = 4) -> None:
    run_lines(run, tag, decimals).write.text(path)


def printed(run: DataFrame, decimals: int = 4) -> DataFrame:
    """Scores as a run file shows them, which is what an evaluation sees."""
    return run.withColumn("score", fixed(F.col("score").cast("double"), decimals))


def write_tsv(rows: DataFrame, path: str) -> None:
    """One header line and tab-separated rows, in one file, in the rows' order."""
    rows.coalesce(1).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def write_metadata(spark: SparkSession, path: str, values: dict[str, object]) -> None:
    """``KEY: value`` lines in the given order."""
    lines = [(i, f"{k}: {v}") for i, (k, v) in enumerate(values.items())]
    spark.createDataFrame(lines, "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
