"""Comparison and history reports over saved artifacts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import change_percent

METRICS = ("map", "Rprec", "bpref", "recip_rank", "P_5", "P_10", "P_20", "num_ret", "num_rel", "num_rel_ret")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """``path, branch, timestamp, key, value`` of report files below ``path``.

    A file is ``<branch>/<kind>-<yyyyMMdd-HHmmss>.txt``; its lines are ``key: value`` or ``metric all value``.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    stamp = F.regexp_extract("path", r"(\d{8}-\d{6})\.txt$", 1)
    root = path.rstrip("/").rsplit("/", 1)[-1]
    branch = F.regexp_extract("path", rf"/{root}/(.+)/[^/]+$", 1)
    measure = F.split(F.trim("value"), r"\s+")
    is_measure = (F.size(measure) == 3) & (F.get(measure, F.lit(1)) == "all")
    key = F.when(is_measure, F.get(measure, F.lit(0))).otherwise(F.regexp_extract("value", r"^([^:]+):", 1))
    value = F.when(is_measure, F.get(measure, F.lit(2))).otherwise(F.trim(F.regexp_replace("value", r"^[^:]+:", "")))
    rows = lines.select("path", F.url_decode(branch).alias("branch"), F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd-HHmmss")).alias("timestamp"), key.alias("key"), value.alias("value"))
    return rows.where("key <> ''")


def latest(artifacts: DataFrame) -> DataFrame:
    """Of each branch, the rows of its newest file."""
    newest = artifacts.groupBy("branch").agg(F.max_by("path", F.struct("timestamp", "path")).alias("path"))
    return artifacts.join(newest, ["branch", "path"], "left_semi")


def wide(artifacts: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per file with a column per metric; a missing one is null."""
    values = [F.max(F.when(F.col("key") == m, F.col("value").try_cast("double"))).alias(m) for m in metrics]
    return artifacts.groupBy("branch", "path", "timestamp").agg(*values)


def branch_report(metrics: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Branches in order (the original first, then by time) with changes of map.

    ``metrics(branch, timestamp, map, num_rel, num_rel_ret, ...)``;
    ``issues(branch, texts)`` decide each branch: any text that contains
    ``accept`` accepts, else ``reject`` rejects, else it is pending; unknown
    without a row.
    """
    original = (F.col("branch") != "original").cast("int")
    order = Window.orderBy(original, "timestamp", "branch")
    base = F.first("map").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = metrics.withColumns({
        "recall": F.coalesce(F.try_divide(F.col("num_rel_ret"), F.col("num_rel")), F.lit(0.0)),
        "map_delta_vs_previous": F.col("map") - F.lag("map").over(order),
        "map_delta_vs_original": F.col("map") - base,
        "map_change_percent": change_percent(F.col("map"), base),
        "place": F.row_number().over(order),
    })
    if issues is None:
        return out
    told = issues.select("branch", F.explode("texts").alias("t")).withColumn("t", F.lower("t")).groupBy("branch").agg(F.bool_or(F.contains("t", F.lit("accept"))).alias("yes"), F.bool_or(F.contains("t", F.lit("reject"))).alias("no"))
    decided = told.select("branch", F.when(F.col("yes"), "accepted").when(F.col("no"), "rejected").otherwise("pending").alias("decision"))
    return out.join(decided, "branch", "left").withColumn("decision", F.coalesce("decision", F.lit("unknown")))


def compare_to_baseline(metrics: DataFrame, baseline: str, same: tuple[str, ...] = ()) -> DataFrame:
    """Long ``branch, metric, value, baseline, delta, percent``.

    Only branches that agree with the baseline on the ``same`` columns are compared.
    """
    keys = ["branch", *same]
    long = metrics.unpivot(keys, [c for c in metrics.columns if c not in keys and c not in ("path", "timestamp")], "metric", "value")
    base = long.where(F.col("branch") == baseline).select("metric", F.col("value").alias("baseline"), *[F.col(c).alias(f"b_{c}") for c in same])
    joined = long.where(F.col("branch") != baseline).join(base, "metric")
    for c in same:
        joined = joined.where(F.col(c).eqNullSafe(F.col(f"b_{c}"))).drop(f"b_{c}")
    return joined.withColumn("delta", F.col("value") - F.col("baseline")).withColumn("percent", change_percent(F.col("value"), F.col("baseline")))


def history(*kinds: DataFrame) -> DataFrame:
    """All rows in one wide table; what a kind lacks is null."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k, allowMissingColumns=True)
    return out


def timing_summary(times: DataFrame) -> DataFrame:
    """Fastest, slowest and lower median of ``times(label, seconds)``."""
    return times.groupBy("label").agg(F.min("seconds").alias("fastest"), F.max("seconds").alias("slowest"), F.percentile_disc("seconds", 0.5).alias("median") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) within group (order by seconds)").alias("median"))


def timed(label: str, run: Callable[[], object], repeats: int = 5) -> list[tuple[str, float]]:
    """One warm-up, then ``repeats`` timed calls."""
    run()
    out = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        out.append((label, time.perf_counter() - began))
    return out


def markdown(rows: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A table of at most ``most`` rows for people to read."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for r in rows.select(*columns).limit(most).collect():
        lines.append("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)


def spliced(document: str, table: str, marker: str) -> str:
    """``document`` with what is between the marker's start and end replaced."""
    start, end = f"<!-- {marker}:start -->", f"<!-- {marker}:end -->"
    if start not in document or end not in document:
        raise ValueError(f"no {marker} markers")
    return document[: document.index(start) + len(start)] + "\n" + table + "\n" + document[document.index(end) :]


def under_roots(spark: SparkSession, *roots: str) -> DataFrame:
    """Artifacts below several roots; a branch under two of them counts once, by its newest file."""
    out = read_artifacts(spark, roots[0])
    for root in roots[1:]:
        out = out.unionByName(read_artifacts(spark, root))
    return latest(out)


def headline(report: DataFrame) -> str:
    """One line: the best branch by map, its value and change, and how many branches there are."""
    best = report.orderBy(F.desc_nulls_last("map"), "branch").first()
    if best is None or best["map"] is None:
        return "no measured branches"
    change = best["map_change_percent"]
    told = "" if change is None else f" ({change:+.2f} % against the original)"
    return f"best of {report.count()} branches: {best['branch']}, map {best['map']:.4f}{told}"


def dashboard(spark: SparkSession, roots: list[str], document: str, issues: DataFrame | None = None, marker: str = "metrics") -> str:
    """``document`` with the newest measures of all branches and their headline between its markers."""
    told = branch_report(wide(under_roots(spark, *roots)), issues)
    columns = ["branch", "map", "map_delta_vs_previous", "map_delta_vs_original", "map_change_percent", "recall", *(["decision"] if issues is not None else [])]
    return spliced(document, headline(told) + "\n\n" + markdown(told.orderBy("place"), columns), marker)
