"""Toxicity from a bidirectional gated recurrent network, trained in numpy.

Words enter as the mean of hashed character-gram embeddings, a hashed word
embedding and log-odds of both in the labelled sample. Two gated recurrent
layers read each window of 32 words forwards and backwards; attention pools
their states into one logit. All overlapping windows of a text are scored and
its largest logit, with the number of windows, gives the probability. Windows
start every 16 words, so a stretch of up to 17 words lies whole in one of them;
longer ones may be cut, with 16 words in both windows at least.

A text's label is that of its strongest window: every epoch scores all windows
of all labelled texts, long ones too, and learns from each text's strongest one
(and, for clean texts, from some others, which must be clean as well).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out, labelled_texts, sample_labels
from .words import CHUNK_BYTES, Words, chunks, mixed

#: Labelled rows of each class that a fit uses at most.
FIT_ROWS = 800
WINDOW, STRIDE, HIDDEN, CHARS, WORDS_DIM = 32, 16, 8, 8, 4
GRAMS, BUCKETS = 1 << 15, 1 << 14
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.01, 1e-3
#: Texts that count for a bucket before it is seen, shared by both classes.
PSEUDO = 4.0
#: Windows of a clean text that an epoch adds to its strongest one; any will do.
CLEAN_WINDOWS = 2
LOWEST = -8.0


def grams_of(w: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram buckets of the words at positions ``first`` and how many each has.

    Every byte starts a gram of up to four bytes of its word; the gram at the
    word's start is told from the same one inside.
    """
    size = (w.end - w.start)[first]
    at = np.repeat(w.start[first] - np.cumsum(size) + size, size) + np.arange(size.sum())
    left = np.repeat(w.end[first], size) - at
    last = max(len(w.data) - 1, 0)
    code = w.data[at].astype(np.uint64)
    for k in (1, 2, 3):
        code |= np.where(left > k, w.data[np.minimum(at + k, last)], 0).astype(np.uint64) << np.uint64(8 * k)
    code[np.cumsum(size) - size] |= np.uint64(1 << 40)
    return (mixed(code) % np.uint64(GRAMS)).astype(np.int64), size


def windows_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of every window; each text is covered whole."""
    many = np.where(w.counts > WINDOW, -(-(w.counts - WINDOW) // STRIDE) + 1, np.minimum(w.counts, 1))
    of = np.repeat(np.arange(len(many)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    start = np.minimum(k * STRIDE, np.maximum(w.counts[of] - WINDOW, 0))
    return w.first[of] + start, np.minimum(w.counts[of], WINDOW), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Odds:
    """Log-odds of gram and word buckets between the classes' texts."""

    grams: np.ndarray
    words: np.ndarray

    @classmethod
    def count(cls, texts: list[list[str]], y: np.ndarray, uses: list[np.ndarray]) -> list[Odds]:
        """One table for each subset of the texts (``uses``: masks); ``texts`` come in parts."""
        have = [[np.zeros((2, width)) for width in (GRAMS, BUCKETS)] for _ in uses]
        at = 0
        for part in texts:
            w = Words(pa.array(part, pa.string()))
            own = slice(at, at + len(part))
            at += len(part)
            grams, size = grams_of(w, np.arange(len(w.start)))
            for j, (bucket, of, width) in enumerate(((grams, np.repeat(w.doc, size), GRAMS), ((w.hashes % np.uint64(BUCKETS)).astype(np.int64), w.doc, BUCKETS))):
                seen = np.unique(bucket * len(part) + of)
                doc = seen % len(part)
                for k, use in enumerate(uses):
                    for label in (0, 1):
                        chosen = use[own][doc] & (y[own][doc] == label)
                        have[k][j][label] += np.bincount(seen[chosen] // len(part), minlength=width)
        out = []
        for k, use in enumerate(uses):
            rows = [max(int((use & (y == label)).sum()), 1) for label in (0, 1)]
            least = PSEUDO / sum(rows)
            out.append(cls(*[np.log((t[1] / rows[1] + least) / (t[0] / rows[0] + least)).astype(np.float32) for t in have[k]]))
        return out


def _inputs(w: Words, first: np.ndarray, p: dict[str, np.ndarray], odds: Odds):
    """Input rows of the words at ``first``, and what a backward step needs."""
    grams, size = grams_of(w, first)
    edge = np.cumsum(size) - size
    bucket = (w.hashes[first] % np.uint64(BUCKETS)).astype(np.int64)
    if not len(first):
        return np.empty((0, CHARS + WORDS_DIM + 3), np.float32), (grams, size, bucket)
    g = odds.grams[grams]
    each = 1 / size.astype(np.float32)[:, None]
    x = np.hstack([np.add.reduceat(p["chars"][grams], edge) * each, p["words"][bucket], np.maximum.reduceat(g, edge)[:, None], np.add.reduceat(g, edge)[:, None] * each, odds.words[bucket][:, None]])
    return x.astype(np.float32), (grams, size, bucket)


def _start() -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(5))
    width = CHARS + WORDS_DIM + 3
    new = {"chars": rng.normal(size=(GRAMS, CHARS)) * 0.3, "words": rng.normal(size=(BUCKETS, WORDS_DIM)) * 0.3, "va": np.zeros(HIDDEN), "wa": rng.normal(size=(2 * HIDDEN, HIDDEN)) * 0.3, "wo": rng.normal(size=2 * HIDDEN) * 0.3, "bo": np.zeros(1)}
    new["va"] = rng.normal(size=HIDDEN) * 0.3
    for d in "fb":
        new |= {f"w{d}": rng.normal(size=(width, 3 * HIDDEN)) / np.sqrt(width), f"u{d}": rng.normal(size=(HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN), f"b{d}": np.zeros(3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in new.items()}


def _forward(p: dict[str, np.ndarray], projected: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray):
    """Logits of windows; ``index`` (time, window) points into projected inputs."""
    t, n = index.shape
    states, saved = np.zeros((t, n, 2 * HIDDEN), np.float32), {}
    h2 = 2 * HIDDEN
    for d in "fb":
        h, u, own = np.zeros((n, HIDDEN), np.float32), p[f"u{d}"], {}
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            a = projected[d][index[s]]
            b = h @ u
            gates = _sigmoid(a[:, :h2] + b[:, :h2])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[:, h2:] + r * b[:, h2:])
            new = (c + z * (h - c)) * mask[s][:, None]
            own[s] = (h, z, r, c, b[:, h2:])
            h = new
            states[s, :, (0 if d == "f" else HIDDEN) : (HIDDEN if d == "f" else h2)] = h
        saved[d] = own
    e = np.tanh(states @ p["wa"])
    weight = np.exp(np.clip(e @ p["va"], -20, 20)) * mask
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = (weight[:, :, None] * states).sum(0)
    return pooled @ p["wo"] + p["bo"][0], (states, saved, e, weight, pooled)


def _gathered(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that share a place, for ``n`` places."""
    order = np.argsort(at, kind="stable")
    own, edge = np.unique(at[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(own):
        out[own] = np.add.reduceat(rows[order], edge)
    return out


def _infer(p: dict[str, np.ndarray], projected: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The logits of ``_forward``, laid out so that every operation is contiguous."""
    t, n = index.shape
    h2 = 2 * HIDDEN
    half = np.ones((3 * HIDDEN, 1), np.float32)
    half[:h2] = 0.5  # a sigmoid is a tanh of half the argument
    rows = {d: projected[d] * half.T for d in "fb"}
    ut = {d: np.ascontiguousarray(p[f"u{d}"].T * half) for d in "fb"}
    wa, va, wo = np.ascontiguousarray(p["wa"].T), p["va"], p["wo"]
    whole = mask.all(axis=1)
    ahead = np.empty((t, HIDDEN, n), np.float32)
    top, below = np.zeros(n, np.float32), np.full(n, 1e-9, np.float32)
    both = np.empty((h2, n), np.float32)
    for d in "fb":
        h = np.zeros((HIDDEN, n), np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            a = np.ascontiguousarray(rows[d][index[s]].T)
            b = ut[d] @ h
            gates = a[:h2]
            gates += b[:h2]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            c = a[h2:]
            b[h2:] *= gates[HIDDEN:]
            c += b[h2:]
            np.tanh(c, out=c)
            h -= c
            h *= gates[:HIDDEN]
            h += c
            if not whole[s]:
                h *= mask[s]
            if d == "f":
                ahead[s] = h
                continue
            both[:HIDDEN], both[HIDDEN:] = ahead[s], h
            e = wa @ both
            np.tanh(e, out=e)
            weight = np.exp(np.clip(va @ e, -20, 20))
            if not whole[s]:
                weight *= mask[s]
            below += weight
            weight *= wo @ both
            top += weight
    return top / below + p["bo"][0]


def _backward(p, projected, index, mask, saved, delta):
    """Gradients of parameters and of the projected inputs of each direction."""
    states, steps, e, weight, pooled = saved
    g = {"wo": pooled.T @ delta, "bo": np.array([delta.sum()])}
    d_pooled = delta[:, None] * p["wo"]
    score = (states * d_pooled).sum(2)
    d_e = (weight * (score - (weight * score).sum(0)))[:, :, None] * p["va"]
    g["va"] = ((weight * (score - (weight * score).sum(0)))[:, :, None] * e).sum((0, 1))
    d_e *= 1 - e**2
    g["wa"] = np.einsum("tni,tnj->ij", states, d_e)
    d_states = weight[:, :, None] * d_pooled + d_e @ p["wa"].T
    t, n = index.shape
    h2 = 2 * HIDDEN
    for d in "fb":
        g[f"u{d}"] = np.zeros_like(p[f"u{d}"])
        each, carry, u = np.zeros((t, n, 3 * HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), p[f"u{d}"]
        part = d_states[:, :, :HIDDEN] if d == "f" else d_states[:, :, HIDDEN:]
        for s in range(t - 1, -1, -1) if d == "f" else range(t):
            h, z, r, c, b = steps[d][s]
            dh = (part[s] + carry) * mask[s][:, None]
            dc = dh * (1 - z) * (1 - c**2)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * b * r * (1 - r)
            da = np.hstack([dz, dr, dc])
            db = np.hstack([dz, dr, dc * r])
            g[f"u{d}"] += h.T @ db
            carry = dh * z + db @ u.T
            each[s] = da
        g[f"in{d}"] = _gathered(each.reshape(-1, 3 * HIDDEN), index.ravel(), len(projected[d]))
    return g


@dataclass
class ToxicityModel:
    p: dict[str, np.ndarray]
    odds: Odds | None
    platt: tuple[float, float, float]

    def window_logits(self, w: Words, first: np.ndarray, many: np.ndarray) -> np.ndarray:
        """One logit per window of ``many`` words from word ``first`` on."""
        _, one, index = np.unique(w.hashes, return_index=True, return_inverse=True)
        x, _ = _inputs(w, one, self.p, self.odds)
        projected = {d: x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb"}
        out = np.empty(len(first), np.float32)
        steps = np.arange(WINDOW)[:, None]
        for at in range(0, len(first), 1024):
            f, m = first[at : at + 1024], many[at : at + 1024]
            inside = steps < m
            words = np.where(inside, np.minimum(f + steps, len(index) - 1), 0)
            out[at : at + 1024] = _infer(self.p, projected, index[words], inside.astype(np.float32))
        return out

    def logits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(largest window logit, windows) of each text."""
        first, many, of = windows_of(w)
        n = len(w.counts)
        best = np.full(n, LOWEST, np.float32)
        if len(first):
            np.maximum.at(best, of, self.window_logits(w, first, many))
        return best, np.bincount(of, minlength=n)

    def scores(self, texts: pa.Array) -> np.ndarray:
        a, b, c = self.platt
        if self.odds is None:
            return np.full(len(texts), float(_sigmoid(np.array(c))))
        best, many = self.logits(Words(texts))
        return _sigmoid(a * best + b * np.log(np.maximum(many, 1)) + c).astype(float)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    beta, penalty = np.zeros(x.shape[1]), np.diag([0.1, 0.1, 0.0])
    for _ in range(30):
        q = _sigmoid(x @ beta)
        hess = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + penalty
        beta = beta - np.clip(np.linalg.solve(hess + 1e-6 * np.eye(len(beta)), x.T @ (weight * (q - y)) + penalty @ beta), -2, 2)
    return beta


def _parts(texts: list[str], most: int = CHUNK_BYTES) -> list[list[str]]:
    """The texts in runs of about ``most`` characters (one text at least)."""
    out, size = [[]], 0
    for t in texts:
        if out[-1] and size + len(t) > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return [p for p in out if p]


def _strongest(texts: list[list[str]], y: np.ndarray, strength, rng: np.random.Generator) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Windows to learn from with their texts, and each text's largest strength and windows.

    ``strength(w, first, many, text)`` rates windows. Every text gives its strongest
    one, a clean text some others too.
    """
    chosen, source, best, count, at = [], [], np.full(len(y), LOWEST), np.zeros(len(y), np.int64), 0
    for part in texts:
        w = Words(pa.array(part, pa.string()))
        first, many, of = windows_of(w)
        if len(first):
            rate = strength(w, first, many, at + of)
            np.maximum.at(best, at + of, rate)
            count[at : at + len(part)] = np.bincount(of, minlength=len(part))
            order = np.lexsort((-rate, of))
            top = order[np.searchsorted(of[order], np.unique(of))]
            begin = np.cumsum(count[at : at + len(part)]) - count[at : at + len(part)]
            clean = np.flatnonzero((y[at : at + len(part)] == 0) & (count[at : at + len(part)] > 1))
            other = (begin[clean, None] + rng.integers(0, count[at + clean][:, None], (len(clean), CLEAN_WINDOWS))).ravel()
            for i in np.concatenate([top, np.setdiff1d(other, top)]):
                chosen.append(w.data[w.start[first[i]] : w.end[first[i] + many[i] - 1]].tobytes())
                source.append(at + of[i])
        at += len(part)
    return chosen, np.array(source, np.int64), best, count


def train(texts: list[str], y: np.ndarray, prior: float, use_odds: bool = True) -> ToxicityModel:
    """Fit the network to whole texts with labels ``y``.

    Without ``use_odds`` the log-odds inputs are zero (to tell what they add).
    """
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else prior, 0.01), 0.99)
        return ToxicityModel({}, None, (0.0, 0.0, float(np.log(share / (1 - share)))))
    parts = _parts(texts)
    half = mixed(np.arange(len(y), dtype=np.uint64) + np.uint64(9)) % np.uint64(2) == 0
    odds, *crossed = Odds.count(parts, y, [np.ones(len(y), bool), ~half, half])  # each half sees the other's odds
    if not use_odds:
        odds, crossed = Odds(odds.grams * 0, odds.words * 0), [Odds(o.grams * 0, o.words * 0) for o in crossed]
    p = _start()

    def told(w: Words, first: np.ndarray, many: np.ndarray, text: np.ndarray) -> np.ndarray:
        by_odds = [_inputs(w, np.arange(len(w.start)), p, o)[0][:, -3:] for o in crossed]
        sums = [np.concatenate([[0], np.cumsum(np.maximum(x[:, 2], 0) + np.maximum(x[:, 0], 0))]) for x in by_odds]
        return np.where(half[text], *[x[first + many] - x[first] for x in sums])

    def scored(w: Words, first: np.ndarray, many: np.ndarray, text: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), np.float32)
        for side, o in ((half[text], crossed[0]), (~half[text], crossed[1])):
            if side.any():
                out[side] = ToxicityModel(p, o, (1.0, 0.0, 0.0)).window_logits(w, first[side], many[side])
        return out

    rng = np.random.Generator(np.random.PCG64(3))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        chosen, source, _, _ = _strongest(parts, y, scored if epoch else told, rng)
        w = Words(pa.array(chosen, pa.binary()).cast(pa.string()))
        first, many, every = w.first[:-1], w.counts, np.arange(len(w.start))
        by_odds = [_inputs(w, every, p, o)[0][:, -3:] for o in crossed]
        extra = np.where(half[source[w.doc]][:, None], *by_odds)
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
            steps = np.arange(WINDOW)[:, None]
            mask = (steps < many[part]).astype(np.float32)
            words = np.where(mask > 0, np.minimum(first[part] + steps, len(every) - 1), first[part])
            own, index = np.unique(words, return_inverse=True)
            index = index.reshape(words.shape)
            x, (grams, size, bucket) = _inputs(w, own, p, odds)
            x[:, -3:] = extra[own]
            projected = {d: x @ p[f"w{d}"] + p[f"b{d}"] for d in "fb"}
            logit, saved = _forward(p, projected, index, mask)
            delta = ((_sigmoid(logit) - y[source[part]]) / len(part)).astype(np.float32)
            g = _backward(p, projected, index, mask, saved, delta)
            dx = 0
            for d in "fb":
                d_in = g.pop(f"in{d}")
                g[f"w{d}"], g[f"b{d}"] = x.T @ d_in, d_in.sum(0)
                dx = dx + d_in @ p[f"w{d}"].T
            g["chars"] = _gathered(np.repeat(dx[:, :CHARS] / size[:, None], size, axis=0), grams, GRAMS)
            g["words"] = _gathered(dx[:, CHARS : CHARS + WORDS_DIM], bucket, BUCKETS)
            step += 1
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v**2 - s)
                p[k] -= (RATE * DECAY * p[k] + RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    model = ToxicityModel(p, odds, (1.0, 0.0, 0.0))
    _, _, best, n_windows = _strongest(parts, y, scored, rng)
    x = np.column_stack([best, np.log(np.maximum(n_windows, 1)), np.ones(len(y))])
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    model.platt = tuple(float(b) for b in _logistic(x, y.astype(float), weight))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, use_odds: bool = True) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents of each class, whole texts.

    Rows held out by id are never used. Of the texts of a repeated id the
    smallest counts. With one class or none the score is constant.
    """
    found = labelled_texts(docs, sample_labels(labels, "toxic", rows)).orderBy("doc_id").toPandas()  # 2 * rows at most
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    return train(found.text.tolist(), found.y.to_numpy(np.int64), min(max(known or 0.5, 0.01), 0.99), use_odds)


def _score(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ToxicityModel = shared.value
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part.column("text")), pa.float64())], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null,
    empty and wordless texts have no window and score as the least toxic one.
    Repeated rows stay; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    slim = texts.mapInArrow(_score(shared), "doc_id long, score double")
    return slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
