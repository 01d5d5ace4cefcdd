"""Scores and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(n_docs / df)


def bm25(tf: Column, length: Column, mean: Column, k1: Column | float, b: Column | float) -> Column:
    """Term frequency saturation; without lengths where the mean is 0."""
    k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (k1, b))
    norm = F.when(mean > 0, k1 * (F.lit(1.0) - b + b * length / F.when(mean > 0, mean).otherwise(F.lit(1.0)))).otherwise(k1)
    return tf * (k1 + 1.0) / (tf + norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector at length 1; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def change_percent(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / before * 100.0)


def fixed(x: Column, decimals: int) -> Column:
    """``x`` at ``decimals`` (11 at most) places as C and SQL print it: its binary value rounded, exact ties to even.

    The JVM's formatter and ``round`` go by the shortest decimals instead, by
    which 0.00045 (binary: just below) becomes 0.0005. What x times ten to the
    places loses in a double is kept beside it (Dekker's product), so the
    rounding is exact.
    """
    ten = F.lit(float(10**decimals))
    a = F.abs(x)
    cut = a * 134217729.0
    high = cut - (cut - a)
    times = a * ten
    lost = (high * ten - times) + (a - high) * ten
    whole = F.floor(times)
    above = (times - whole - 0.5) + lost
    near = whole + F.when((above > 0) | ((above == 0) & (whole % 2 == 1)), 1).otherwise(0)
    return F.when(a * ten < 2.0**53, near / ten * F.when(x < 0, -1.0).otherwise(1.0)).otherwise(x)
