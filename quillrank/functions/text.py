"""Lexer, normaliser and query parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A tag up to ">" or the line's end, or an alphanumeric run with inner hyphens.
TOKEN = r"<[^>\n]*>?|[A-Za-z0-9][A-Za-z0-9-]*"
LONGEST_TERM = 255


def raw_tokens(text: Column) -> Column:
    """Tags and words of a text in order, as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def normalise(token: Column) -> Column:
    """Lower case, a light plural rule, and at most 255 bytes.

    The first rule that holds applies: ``ies`` to ``y``, ``sses`` to ``ss``,
    ``ches shes xes zes`` without ``es`` (all above four letters), and a final
    ``s`` dropped above three, but not of ``ss us is`` or ``news``.
    """
    t = F.lower(token)
    n = F.length(t)

    def ends(*suffixes: str) -> Column:
        found = t.endswith(suffixes[0])
        for s in suffixes[1:]:
            found = found | t.endswith(s)
        return found

    def cut(k: int) -> Column:
        return F.substring(t, F.lit(1), n - k)

    stem = (
        F.when((n > 4) & ends("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & ends("sses", "ches", "shes", "xes", "zes"), cut(2))
        .when((n > 3) & ends("s") & ~ends("ss", "us", "is") & (t != "news"), cut(1))
        .otherwise(t)
    )
    return F.substring(stem, 1, LONGEST_TERM)


def body_terms(text: Column) -> Column:
    """Normalised words of an untagged text, tags left out."""
    return F.transform(F.filter(raw_tokens(text), lambda t: ~t.startswith("<")), normalise)


def whitespace_parts(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    """Words of a text, as an estimate of model tokens."""
    return F.size(whitespace_parts(text))


def model_terms(text: Column) -> Column:
    """Lower-case alphanumeric runs, the terms that rewriting works on."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def topic_id(line: Column, fallback: Column) -> Column:
    """A leading integer of the line, printed as one; else the fallback."""
    first = F.get(whitespace_parts(line), F.lit(0))
    number = F.when(first.rlike(r"^[+-]?[0-9]{1,18}$"), first.cast("long").cast("string"))
    return F.coalesce(number, fallback.cast("string"))


def topic_words(line: Column) -> Column:
    """Normalised words of a topic line without its leading id."""
    parts = whitespace_parts(line)
    led = F.coalesce(F.get(parts, F.lit(0)).rlike(r"^[+-]?[0-9]{1,18}$"), F.lit(False))
    return F.transform(F.when(led, F.slice(parts, 2, 1_000_000)).otherwise(parts), normalise)


def topic_text(line: Column) -> Column:
    """A topic line without its leading id, its words as written; empty if the id is all there is."""
    parts = whitespace_parts(line)
    led = F.coalesce(F.get(parts, F.lit(0)).rlike(r"^[+-]?[0-9]{1,18}$"), F.lit(False))
    return F.array_join(F.when(led, F.slice(parts, 2, 1_000_000)).otherwise(parts), " ")
