"""Tagged text collections: documents, fields and weighted tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, raw_tokens

# Fields that aren't indexed, and the field that weighs double.
IGNORED = ("DOCNO", "DD", "SO", "IN", "DATELINE")
BOOSTED = "HL"


@dataclass(frozen=True)
class Fields:
    """Which tags' contents are ignored, and which one's count ``weight`` times.

    ``by_name``: tags match on their name alone, with attributes and in any case.
    """

    ignored: tuple[str, ...] = IGNORED
    boosted: str = BOOSTED
    key: str | None = "DOCNO"
    weight: int = 2
    by_name: bool = False


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """``doc_ord, doc_no, text`` of all ``<DOC>`` records of the files below ``path``.

    A record runs from one ``<DOC>`` to the next; what a file holds before its
    first is dropped. Ordinals count from 0 over files in path order. Large
    files are split between records; a split's records are numbered where they
    are read and shifted by a table of one row per split.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "<DOC>").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    splits = splits.withColumn("lead", (F.col("start") == 0).cast("int"))  # the text before a file's first record
    before = F.coalesce(F.sum(F.col("lines") - F.col("lead")).over(Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(splits.withColumn("before", before).select("path", "start", "first", "lead", "before"), ["path", "start"])
    records = placed.withColumn("n", F.col("id") - F.col("first") - F.col("lead")).where("n >= 0")
    key = F.regexp_extract("value", r"<DOCNO>\s*([A-Za-z0-9][A-Za-z0-9-]*)", 1)
    return records.select((F.col("before") + F.col("n")).alias("doc_ord"), key.alias("doc_no"), F.col("value").alias("text"))


def _tag(fields: Fields):
    if not fields.by_name:
        return F.col("token")
    name = F.lower(F.regexp_extract("token", r"^<(/?[A-Za-z0-9]+)", 1))
    return F.when(F.col("token").startswith("<") & (name != ""), F.concat(F.lit("<"), name, F.lit(">"))).otherwise(F.col("token"))


def weighted_tokens(docs: DataFrame, fields: Fields = Fields()) -> DataFrame:
    """``doc_ord, pos, term, weight`` of the indexable words of ``docs(doc_ord, text)``.

    An ignored field lasts until its own closing tag; the opening tag of another ignored one inside
    it makes that one's closing tag the awaited one. The key token right after
    its tag isn't indexed. ``pos`` orders the words within a document.
    """
    named = [x.lower() if fields.by_name else x for x in (*fields.ignored, fields.boosted)]
    ignored, boosted = named[:-1], named[-1]
    opening = [f"<{x}>" for x in ignored]
    tokens = docs.select("doc_ord", F.posexplode(raw_tokens(F.col("text"))).alias("pos", "token")).withColumn("tag", _tag(fields))
    running = Window.partitionBy("doc_ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("tag") == f"<{boosted}>", 1).when(F.col("tag") == f"</{boosted}>", 0)
    lined = tokens.withColumn("in_boosted", F.coalesce(F.last(mark, ignorenulls=True).over(running), F.lit(0)))
    plain = lined.where(~F.col("tag").isin(f"<{boosted}>", f"</{boosted}>"))
    if fields.key:
        plain = plain.withColumn("pushed", F.coalesce(F.lag("tag").over(Window.partitionBy("doc_ord").orderBy("pos")) == f"<{fields.key}>", F.lit(False))).where("not pushed")
    opens = F.col("tag").isin(opening)
    state = plain.withColumn("seg", F.sum(opens.cast("int")).over(running)).withColumn("opener", F.last(F.when(opens, F.col("tag")), ignorenulls=True).over(running))
    closer = F.concat(F.lit("</"), F.substring("opener", 2, 1_000))
    within = Window.partitionBy("doc_ord", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    closed = F.coalesce(F.max((F.col("tag") == closer).cast("int")).over(within), F.lit(0))
    open_now = state.withColumn("closed", closed).where(((F.col("seg") == 0) | (F.col("closed") == 1)) & ~F.col("token").startswith("<"))
    return open_now.select("doc_ord", "pos", normalise(F.col("token")).alias("term"), F.when(F.col("in_boosted") == 1, fields.weight).otherwise(1).alias("weight"))
