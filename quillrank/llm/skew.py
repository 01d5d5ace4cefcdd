"""Joins and numbering that no hot key, group or run of repeated rows can slow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: A key with more than one part in so many of all rows is hot; fewer keys than
#: this can be, so facts of hot keys are broadcast.
HOT = 2048
#: Copies of one repeated row that are listed at once.
BLOCK = 100_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row per ``key``.

    ``facts`` tells in ``size`` how many of the ``total`` rows have its key.
    Rows of hot keys stay where they are; the others are joined by shuffle.
    ``rows`` is read twice and should be stored.
    """
    hot = F.col(size) * HOT > total
    few = F.broadcast(facts.where(hot))  # fewer than HOT rows
    cold = rows.join(F.broadcast(facts.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(facts.where(~hot), key))


def with_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, spread: Column, how: str = "left") -> DataFrame:
    """As ``join_facts``, reading ``rows`` once; ``how`` is ``left`` or ``inner``.

    Rows of hot keys meet their facts by broadcast and are then dealt by
    ``spread``, a long that differs between them. ``key`` is a long or string.
    """
    names = [c for c in facts.columns if c not in (key, size)]
    hot = F.col(size) * HOT > total
    packed = facts.select(F.col(key).alias("__key"), F.struct(*names).alias("__facts"), hot.alias("__hot"))
    kind = dict(rows.dtypes)[key]
    first = rows.join(F.broadcast(packed.where("__hot").select("__key", F.col("__facts").alias("__near"))), F.col(key) == F.col("__key"), "left").drop("__key")
    dealt = first.withColumn("__deal", F.when(F.col("__near").isNull(), F.col(key)).otherwise(spread.cast(kind)))
    met = dealt.join(packed.where("not __hot").select("__key", "__facts"), F.col("__deal") == F.col("__key"), "left").drop("__key", "__deal")
    found = met.withColumn("__facts", F.coalesce("__near", "__facts")).drop("__near")
    found = found.where("__facts is not null") if how == "inner" else found
    return found.select(*rows.columns, *[F.col(f"__facts.{c}").alias(c) for c in names])


def counted(rows: DataFrame, copy: str = "copy") -> DataFrame:
    """Every row with its number among equal rows (``copy``, from 0).

    Equal rows are counted where they lie and listed again, so the result does
    not depend on how the rows were dealt out.
    """
    many = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    blocks = many.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BLOCK))))
    last = F.least(F.col("__n"), (F.col("__block") + 1) * BLOCK) - 1
    return blocks.withColumn(copy, F.explode(F.sequence(F.col("__block") * BLOCK, last))).drop("__n", "__block")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their position from 0 in ``order``, sorted in ranges.

    Only one number per range reaches the driver.
    """
    placed = stored(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("__id", 33)
    counts = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}
    before, at = [], 0
    for p in sorted(counts):
        before.append((p, at))
        at += counts[p]
    spark = rows.sparkSession
    offsets = spark.createDataFrame(before, "__part long, __before long")
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part.cast("long")).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + inside).drop("__id", "__part", "__before")
