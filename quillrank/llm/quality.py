"""Quality scores from random Fourier features of document statistics.

A cosine map with random frequencies approximates a Gaussian kernel over
standardised statistics of a text. Each partition of labelled rows sums its
part of the normal equations; their total gives ridge weights. Held-back
labelled rows then fit a monotone (isotonic) map from ridge score to
probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import class_counts, held_out, labelled_texts, sample_labels
from .storage import stored
from .words import Words, chunks

#: Labelled rows of each class that a fit uses at most.
FIT_ROWS = 6000
FEATURES, BANDWIDTH, RIDGE, SUM_PARTITIONS = 256, 3.0, 1.0, 8
THRESHOLD = 0.3
#: Share of the ridge score itself, which orders rows within an isotonic step.
BLEND = 0.02

_CLASS = np.zeros(256, np.int64)  # 0 other, then space, line end, lower, upper, digit, beyond ASCII
_CLASS[[32, 9, 11, 12, 13]] = 1
_CLASS[10] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[128:] = 6


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; zeros for a text without bytes."""
    w = Words(texts)
    n, sizes = len(w.counts), np.diff(w.edges).astype(float)
    kinds = _CLASS[w.raw]
    of = np.repeat(np.arange(n), np.diff(w.edges))
    count = np.bincount(of * 7 + kinds, minlength=7 * n).reshape(n, 7).astype(float)
    share = count / np.maximum(sizes, 1)[:, None]
    odd = kinds == 0
    pairs = np.bincount(of[1:][odd[1:] & odd[:-1] & (of[1:] == of[:-1])], minlength=n) / np.maximum(sizes, 1)

    counts = np.maximum(w.counts, 1).astype(float)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, length, n) / counts
    spread = np.sqrt(np.maximum(np.bincount(w.doc, length**2, n) / counts - mean**2, 0))
    last, first = kinds[w.end - 1] if len(length) else np.empty(0, int), kinds[w.start] if len(length) else np.empty(0, int)
    marks = np.concatenate([[0], np.cumsum(odd)])
    bare = (marks[w.end] - marks[w.start]) == length
    caps = np.concatenate([[0], np.cumsum(kinds == 4)])
    shout = (caps[w.end] - caps[w.start]) * 2 >= length
    of_words = [np.bincount(w.doc[x], minlength=n) / counts for x in (last == 0, first == 0, bare, shout & (length > 1), length <= 3, length >= 14)]
    order = np.lexsort((w.hashes, w.doc))
    h, d = w.hashes[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n) / counts
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[new], runs)
    shingles, many = w.shingles(5)
    fresh = np.array([len(np.unique(x)) for x in np.split(shingles, np.cumsum(many)[:-1])]) / np.maximum(many, 1) if n else np.zeros(0)
    lines = count[:, 2] + (sizes > 0)
    columns = [np.log1p(sizes), np.log1p(w.counts), *share.T, pairs, mean, spread, *of_words, distinct, top / counts, fresh, np.log1p(lines), np.log1p(sizes / np.maximum(lines, 1))]
    return np.stack(columns, axis=1)


@dataclass
class QualityModel:
    """Standardisation, random map, ridge weights and isotonic steps."""

    centre: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def mapped(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.waves + self.phases) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), float(self.steps[1][0]))
        raw = self.mapped(stats) @ self.weights
        return (1 - BLEND) * np.interp(raw, *self.steps) + BLEND * np.clip(raw, 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x (pool adjacent violators).

    A pooled block is level from its smallest to its largest x; rows count
    ``weight`` times (once without it).
    """
    blocks: list[list[float]] = []  # weighted sum of y, weight, smallest x, largest x
    many = np.ones(len(x)) if weight is None else weight
    for a, b, w in sorted(zip(x.tolist(), y.tolist(), many.tolist(), strict=True)):
        blocks.append([b * w, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    level = np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])
    return np.array([e for b in blocks for e in b[2:]]), np.repeat(level, 2)


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("fold"), pa.array(list(statistics(part.column("text"))), pa.list_(pa.float64()))], names=["y", "fold", "stats"])


def _sums(model: QualityModel | None, weights: np.ndarray):
    """Per partition: moments of the statistics, or the normal equations.

    A row of class y counts ``weights[y]`` times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), float)
            y = batch.column("y").to_numpy()
            w = weights[y][:, None]
            if len(x) and model is None:
                total = total + np.stack([np.full(x.shape[1], w.sum()), (w * x).sum(0), (w * x**2).sum(0)])
            elif len(x):
                z = model.mapped(x)
                total = total + np.hstack([z.T @ (w * z), (w * z).T @ y[:, None].astype(float)])
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _total(rows: DataFrame, model: QualityModel | None, weights: np.ndarray) -> np.ndarray | None:
    parts = rows.mapInArrow(_sums(model, weights), "sums array<double>").collect()  # SUM_PARTITIONS rows at most
    return sum(np.array(p["sums"]) for p in parts) if parts else None


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents of each class.

    Where a class has more, its rows weigh as much as all its labels do, so
    that scores follow the labels' shares. Rows held out by id are never used.
    Of the texts of a repeated id the smallest counts. With labels of one class
    or none, or no documents, the score is constant (that class's, or 0.5).
    """
    chosen = labelled_texts(docs, sample_labels(labels, "quality", rows))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)).cast("int")
    data = chosen.select("text", "y", fold.alias("fold")).mapInArrow(_fit_rows, "y int, fold int, stats array<double>")
    data = stored(data.repartition(SUM_PARTITIONS), "statistics")
    classes = {r["y"]: r["count"] for r in data.where("fold <> 0").groupBy("y").count().collect()}
    if len(classes) < 2:
        return QualityModel(*[np.empty(0)] * 5, steps=(np.zeros(1), np.array([float(next(iter(classes), 0.5))])))
    known = class_counts(labels, "quality")
    real = np.array([known[k] / min(known[k], rows) for k in (0, 1)])
    weights = real * sum(min(known[k], rows) for k in (0, 1)) / sum(known[k] for k in (0, 1))
    n, total, square = _total(data, None, weights).reshape(3, -1)
    rng = np.random.Generator(np.random.PCG64(11))
    width = len(n)
    waves, phases = rng.normal(size=(width, FEATURES)) / BANDWIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    model = QualityModel(total / n, np.sqrt(np.maximum(square / n - (total / n) ** 2, 1e-9)), waves, phases, np.empty(0), (np.zeros(1), np.zeros(1)))
    equations = _total(data.where("fold <> 0"), model, weights).reshape(FEATURES + 1, FEATURES + 2)
    model.weights = np.linalg.solve(equations[:, :-1] + RIDGE * np.eye(FEATURES + 1), equations[:, -1])
    back = data.where("fold = 0").select("y", "stats").collect()  # a quarter of the bounded sample
    if len({r["y"] for r in back}) < 2:
        back = data.select("y", "stats").collect()
    y = np.array([r["y"] for r in back])
    model.steps = isotonic(model.mapped(np.array([r["stats"] for r in back])) @ model.weights, y.astype(float), weights[y])
    return model


def _score(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(statistics(part.column("text"))))], names=[*part.schema.names, "__score"])

    return run


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document.

    ``docs`` needs ``doc_id`` and ``text`` (null: empty, scored like the empty
    text); other columns are ignored. Rows stay as they are, repeated or not.
    """
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    slim = texts.mapInArrow(_slim(model), "doc_id long, score double")
    return slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _slim(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(statistics(part.column("text"))))], names=["doc_id", "score"])

    return run


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*[*names[:at], "text", *names[at + 1 :]])
    schema = ", ".join(f"`{n}` {t}" for n, t in plain.dtypes)
    scored = plain.mapInArrow(_score(model), f"{schema}, __score double")
    return scored.where(F.col("__score") >= threshold).drop("__score").toDF(*docs.columns)
