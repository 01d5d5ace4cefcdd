"""Mixing sources to target weights by entropy balancing, in DataFrame functions.

Per source s the mix should take T_s words. Among all document rates up to the
cap it picks those closest in relative entropy to rate 1 that meet T_s: rate =
min(cap, exp(lambda_s * size)). lambda_s is the root of a convex dual's
gradient, sum(rate * size) - T_s; each Newton iteration is one job that sums
rate * size and rate * size**2 over cells of equal size, for all sources beside
each other, and keeps the step within a bracket that is known from the start:
sizes are whole, so log(T / S) <= lambda <= log(cap) with S the source's words.

Rates become whole copies: the whole part, plus one more for documents whose
hash / fractional part lies below a cut (sequential Poisson sampling). The cut
at which a source's words reach T_s is found by refining it in equal steps, each
a small table of sums; then one document per source closes most of the rest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import counted, ranked
from .storage import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
#: Newton iterations at most, and the relative error at which a source is met.
NEWTON_STEPS, NEWTON_ERROR = 60, 1e-9
#: A cut is refined so often into so many steps; the first covers 0 to 4.
REFINED, STEPS, WIDEST = 4, 64, 4.0
LEVEL_STEPS = 200
#: Up to so many sources their table is broadcast; beyond, it is shuffled.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """``target`` for ``sources(source, source_size, weight)``.

    The targets share ``share`` times all sizes by weight, none above ``cap``
    times its size, what is above going to the others by weight: min(cap *
    size, level * weight) for the one level at which they add up. Each
    resharing sums over all sources; two numbers reach the driver.
    """
    most = F.col("source_size") * F.lit(float(cap))
    left = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, full = 0.0, None
    for _ in range(LEVEL_STEPS):
        over = F.lit(False) if full is None else F.col("weight") * level > most
        row = sources.agg(F.sum(F.when(over, most).otherwise(0.0)).alias("filled"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weights"), F.sum(over.cast("long")).alias("full")).first()
        if row["full"] == full:
            break
        full = row["full"]
        if not row["weights"]:
            level = math.inf
            break
        level = max(level, (left - row["filled"]) / row["weights"])
    target = most if math.isinf(level) else F.least(most, F.col("weight") * level)
    return sources.withColumn("target", target)


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    keyed = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(keyed) if few else keyed, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def _together(sources: DataFrame, few: bool) -> DataFrame:
    """A bounded table of sources in a few files."""
    return sources.coalesce(4) if few else sources


def rate_of(tilt: Column, size: Column, cap: float) -> Column:
    return F.exp(F.least(tilt * size, F.lit(math.log(cap))))


def tilts(cells: DataFrame, sources: DataFrame, cap: float, few: bool) -> DataFrame:
    """``sources(source, source_size, target)`` with ``tilt``, lambda of each.

    ``cells(source, size, n)`` are sums over documents. A source whose target
    is at its cap has the tilt that puts every rate there.
    """
    top = math.log(cap)
    lowest = F.when(F.col("target") < F.col("source_size"), F.log(F.greatest("target", F.lit(1e-300)) / F.col("source_size"))).otherwise(0.0)
    capped = F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12))
    start = sources.withColumn("low", lowest).withColumn("high", F.when(F.col("target") > F.col("source_size"), top).otherwise(0.0))
    state = stored(start.withColumn("tilt", F.when(capped, top).otherwise(0.0)).withColumn("settled", capped | (F.col("source_size") == 0)), "tilts")
    for k in range(NEWTON_STEPS):
        if k % 3 == 0 and not state.where("not settled").limit(1).count():
            break
        open_ = state.where("not settled").select("source", F.col("tilt").alias("__tilt"))
        at = _with_sources(cells, open_, few).where("__tilt is not null")
        words = F.col("n") * F.col("size") * rate_of(F.col("__tilt"), F.col("size"), cap)
        free = F.col("__tilt") * F.col("size") < top
        sums = at.groupBy("source").agg(F.sum(words).alias("words"), F.sum(F.when(free, words * F.col("size")).otherwise(0.0)).alias("slope"))
        now = _with_sources(state, sums, few)
        above = F.col("words") - F.col("target")
        low, high = F.when(above < 0, F.col("tilt")).otherwise(F.col("low")), F.when(above > 0, F.col("tilt")).otherwise(F.col("high"))
        now = now.withColumn("__low", low).withColumn("__high", high).withColumn("__newton", F.col("tilt") - F.try_divide(above, F.col("slope")))
        inside = (F.col("__newton") > F.col("__low")) & (F.col("__newton") < F.col("__high"))
        met = (F.abs(above) <= NEWTON_ERROR * F.col("target")) | (F.col("__high") <= F.col("__low"))
        step = F.when(met, F.col("tilt")).when(inside, F.col("__newton")).otherwise((F.col("__low") + F.col("__high")) / 2)
        open_now = F.col("words").isNotNull()
        fresh = [F.when(open_now, x).otherwise(F.col(name)).alias(name) for name, x in (("low", F.col("__low")), ("high", F.col("__high")), ("tilt", step), ("settled", met))]
        state = stored(_together(now.select("source", "source_size", "target", *fresh), few), "tilts")
    return state.select("source", "source_size", "target", "tilt")


def _cuts(units: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``plan`` with ``cut``: below it, fractional parts are rounded up.

    ``units(source, size, whole, turn)``; turn is null where nothing is left to
    round. The words below the cut never exceed what the source lacks.
    """
    whole = units.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("whole"))
    state = _with_sources(plan, whole, few).withColumn("lack", F.col("target") - F.col("whole")).drop("whole")
    state = stored(_together(state.withColumn("cut", F.lit(0.0)).withColumn("before", F.lit(0).cast("long")), few), "cuts")
    width = WIDEST
    for _ in range(REFINED):
        width /= STEPS
        low = F.col("turn") - F.col("cut")
        here = _with_sources(units.where("turn is not null"), state.select("source", "cut"), few).where((low >= 0) & (low < width * STEPS))
        sums = here.groupBy("source", F.least(F.floor(low / width), F.lit(STEPS - 1)).cast("int").alias("step")).agg(F.sum("size").alias("words"))
        listed = sums.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("step", "words"))).alias("steps"))  # STEPS at most
        begin = F.struct(F.col("before").alias("words"), F.lit(-1).alias("step"), F.lit(False).alias("full"))

        def take(have: Column, cell: Column) -> Column:
            full = have["full"] | (have["words"] + cell["words"] > F.col("lack"))
            return F.struct(F.when(full, have["words"]).otherwise(have["words"] + cell["words"]).alias("words"), F.when(have["full"], have["step"]).otherwise(cell["step"]).alias("step"), full.alias("full"))

        reached = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<step:int,words:bigint>>")), begin, take)
        now = _with_sources(state, listed, few).withColumn("__at", reached)
        cut = F.col("cut") + F.when(F.col("__at.full"), F.col("__at.step")).otherwise(STEPS) * F.lit(width)
        state = stored(_together(now.withColumn("cut", cut).withColumn("before", F.col("__at.words")).select(state.columns), few), "cuts")
    return state.drop("before", "lack")


@dataclass
class Mix:
    """``units(doc_id, source, size, h, copy)``, one per document, and per source ``plan``."""

    units: DataFrame
    plan: DataFrame
    few: bool
    cap: float

    def copies(self, units: DataFrame) -> DataFrame:
        """``units`` with the plan's columns, ``rate`` and ``copies``; nothing is shuffled if sources are few."""
        rated = _rounded(_with_sources(units, self.plan, self.few), self.cap)
        extra = F.coalesce(F.col("turn") < F.col("cut"), F.lit(False)).cast("int")
        closer = F.col("closer").isNotNull() & F.col("closer").eqNullSafe(F.struct("doc_id", "h", "copy"))
        step = F.when(closer, F.col("step")).otherwise(0)
        return rated.withColumn("copies", (F.col("whole") + extra + step).cast("int"))


def _rounded(units: DataFrame, cap: float) -> DataFrame:
    """``units`` with ``rate``, its ``whole`` part and ``turn`` (hash / rest)."""
    rate = F.when((F.col("target") <= 0) & (F.col("size") > 0), F.lit(0.0)).otherwise(rate_of(F.col("tilt"), F.col("size"), cap))
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "h", "copy", F.lit(23)), 12) + 0.5) / float(2**52)
    rest = F.col("rate") - F.col("whole")
    return units.withColumn("rate", near).withColumn("whole", F.floor("rate")).withColumn("turn", F.when((rest > 0) & (F.col("size") > 0), u / rest))


def row_hash(docs: DataFrame) -> Column:
    """A hash of a row's document; equal rows have equal ones."""
    return F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))


def planned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> Mix:
    """Rates and cuts of every source of ``docs(doc_id, text, source)``."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(docs).alias("h"))
    units = stored(counted(slim), "units")
    cells = stored(units.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sized = stored(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), "sources")
    few = sized.count() <= BROADCAST_SOURCES
    sized = _together(sized, few)
    turns = ranked(sized, [F.asc_nulls_last("source")], "__turn")
    weighed = turns.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__turn") % len(weights) + 1).cast("int")))
    levelled = stored(_together(water_level(stored(_together(weighed.drop("__turn"), few), "weights"), share, cap).drop("weight"), few), "targets")
    tilted = stored(tilts(cells, levelled, cap, few), "tilted")
    rated = stored(_rounded(_with_sources(units, tilted, few), cap).select("doc_id", "h", "copy", "source", "size", "whole", "turn"), "rates")
    cut = _cuts(rated, tilted, few)

    taken = _with_sources(rated, cut.select("source", "cut", "target"), few).withColumn("taken", F.col("whole") + F.coalesce(F.col("turn") < F.col("cut"), F.lit(False)).cast("int"))
    rest = taken.groupBy("source").agg((F.max("target") - F.sum(F.col("taken") * F.col("size"))).alias("rest"))
    rested = _with_sources(taken, stored(_together(rest, few), "rest"), few)
    more, less = (F.col("rest") > 0) & (F.col("taken") + 1 <= cap), (F.col("rest") < 0) & (F.col("taken") > 0)
    gap = F.abs(F.abs("rest") - F.col("size"))
    closing = rested.where((more | less) & (gap < F.abs("rest"))).groupBy("source")
    closing = closing.agg(F.min(F.struct(gap.alias("gap"), "doc_id", "h", "copy", F.signum("rest").cast("int").alias("step"))).alias("best"))
    closing = closing.select("source", F.struct("best.doc_id", "best.h", "best.copy").alias("closer"), F.col("best.step").alias("step"))
    return Mix(units, stored(_together(_with_sources(cut, closing, few), few), "plan"), few, cap)


def entropy_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Copies of every document that make up the target mix.

    ``docs`` needs ``doc_id``, ``text``, ``source``; other columns are ignored.
    Sizes are words (null text: 0). Sources in code point order, null last (a
    source of its own), weigh ``weights`` in turn.

    Returns per row ``doc_id``, ``source``, ``size``, ``source_size``,
    ``target``, ``rate``, ``copies`` and ``taken`` (copies * size). No document
    exceeds floor(cap) copies. Order and partitioning of the input do not
    matter: draws depend on the row's values and, for repeated rows, their
    number. Documents without words have rate 1, one copy and 0 taken words.
    An empty table gives no rows.
    """
    mix = planned(docs, weights, share, cap)
    out = mix.copies(mix.units)
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``docs``, all columns, every row as often as the mix takes it.

    Rows that occur once are copied where they lie. Rows that repeat (equal
    ``doc_id``, ``source`` and ``text``) are numbered by their other columns
    and take their copies by that number.
    """
    mix = planned(docs, weights, share, cap)
    keyed = docs.withColumn("__h", row_hash(docs)).withColumn("__doc_id", F.col("doc_id")).withColumn("__origin", F.col("source"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    again = stored(mix.units.where("copy > 0").select(F.col("h").alias("__again")).distinct(), "repeated")
    few = again.count() <= BROADCAST_SOURCES * 10
    listed = F.broadcast(again) if few else again
    once = keyed.join(listed, F.col("__h") == F.col("__again"), "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    many = counted(keyed.join(listed, F.col("__h") == F.col("__again"), "left_semi"), "__other")
    first = many.groupBy("__h", F.xxhash64(*names).alias("__row")).agg(F.count("*").alias("__n"))
    before = first.groupBy("__h").agg(F.sort_array(F.collect_list(F.struct("__row", "__n"))).alias("__rows"))  # rows that differ in other columns only
    ahead = F.aggregate(F.filter("__rows", lambda x: x["__row"] < F.col("__row")), F.lit(0).cast("long"), lambda a, x: a + x["__n"])
    placed = many.withColumn("__row", F.xxhash64(*names)).join(before.withColumnRenamed("__h", "__b"), F.col("__h") == F.col("__b")).withColumn("__copy", ahead + F.col("__other")).drop("__rows", "__row", "__b", "__other")
    rows = once.unionByName(placed)
    shape = rows.select(F.struct(*names).alias("__doc"), F.col("__doc_id").alias("doc_id"), F.col("__h").alias("h"), F.col("__copy").alias("copy"), F.col("__origin").alias("source"), word_count(F.col("text")).alias("size"))
    copied = mix.copies(shape).where("copies > 0").withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
