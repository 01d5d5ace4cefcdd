"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny similarity with it, so whole
documents' signatures tell nothing. Items are therefore partitioned by their
number n of shingles (powers of two from ``FIRST``), and for every partition a
document is cut into blocks of as many shingles as its largest items have. A
block's signature is its smallest value under each of ``SAMPLES`` hash functions;
a band is one sample, since one equal value is evidence enough at this size.
Items of a partition are candidates of a document where one of their samples
equals that sample of one of its blocks.

An item's sample is one shingle. If the document holds ``percent`` of the item,
that shingle is there with this probability, and it is its block's smallest if
none of the block's at most 2n others is smaller than all n of the item: at
least one time in three. So a contained item is missed with probability
(1 - 0.8 / 3) ** SAMPLES = 4e-6 at most, wherever its shingles lie. Items under
``FIRST`` shingles form a partition with blocks of one shingle. Candidates
are verified by exact containment on full sets.

Items go to the executors in blocks of bounded size, each searched by one pass
over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .words import Words, chunks, mixed

#: Item shingles that are sent to every executor at once (16 bytes each).
BLOCK_SHINGLES = 2_000_000
#: Hash functions, and the least shingles of an item of the first partition with blocks.
SAMPLES, FIRST = 40, 8
_MULTIPLY = np.random.Generator(np.random.PCG64(59)).integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def partition_of(size: int) -> int:
    """Shingles of a block that items of ``size`` shingles are sought in."""
    return 1 if size < FIRST else 1 << int(size).bit_length()


def samples_of(own: np.ndarray) -> np.ndarray:
    """The smallest value of a set of hashes under each function."""
    return np.array([(own * m).min() for m in _MULTIPLY])


def _item_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, many = Words(part.column("text")).shingles(n)
                own = [np.unique(x) for x in np.split(hashes, np.cumsum(many)[:-1])]
                of = np.repeat(np.arange(len(own)), [len(x) for x in own])
                values = np.concatenate(own) if own else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(of)), pa.array(values.view(np.int64))], names=["item_id", "shingle"])

    return run


class _Partition:
    """The samples of the items of one size, for each hash function sorted."""

    def __init__(self, width: int, items: list[int], sets: list[np.ndarray]):
        self.width = width
        signatures = np.stack([samples_of(s) for s in sets])
        self.values, self.items = [], []
        for k in range(SAMPLES):
            order = np.argsort(signatures[:, k], kind="stable")
            self.values.append(signatures[order, k])
            self.items.append(np.array(items)[order])
        #: 2**16 marks of sample values, so that most blocks need no search.
        self.marks = np.zeros((SAMPLES, 1 << 16), bool)
        for k in range(SAMPLES):
            self.marks[k, (mixed(self.values[k]) & np.uint64(0xFFFF)).astype(np.int64)] = True


class _Items:
    """Items' sets, and their samples by partition."""

    def __init__(self, ids: np.ndarray, shingles: np.ndarray):
        order = np.lexsort((shingles, ids))
        self.names, first = np.unique(ids[order], return_index=True)
        self.sets = np.split(shingles[order], first[1:])
        widths = np.array([partition_of(len(s)) for s in self.sets])
        self.partitions = [_Partition(int(w), np.flatnonzero(widths == w).tolist(), [self.sets[i] for i in np.flatnonzero(widths == w)]) for w in np.unique(widths)]

    def candidates(self, hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Pairs (text, item) that share a sample, of texts with ``hashes[edges[i]:edges[i + 1]]``."""
        found = []
        for part in self.partitions:
            many = -(-np.diff(edges) // part.width)
            text = np.repeat(np.arange(len(many)), many)
            start = edges[text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * part.width
            if not len(start):
                continue
            for k, m in enumerate(_MULTIPLY):
                least = hashes * m if part.width == 1 else np.minimum.reduceat(hashes * m, start)
                at = np.flatnonzero(part.marks[k, (mixed(least) & np.uint64(0xFFFF)).astype(np.int64)])
                low, high = np.searchsorted(part.values[k], least[at]), np.searchsorted(part.values[k], least[at], "right")
                for i, a, b in zip(at[high > low], low[high > low], high[high > low], strict=True):
                    found.append(np.column_stack([np.full(b - a, text[i]), part.items[k][a:b]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


_SCHEMA = "doc_id long, item_id long, item_shingles long, shared long"


def _search(items, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Items = items.value
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, many = Words(part.column("text")).shingles(n)
                edges = np.concatenate([[0], np.cumsum(many)])
                found, now, own = [], -1, None
                for d, i in known.candidates(hashes, edges).tolist():
                    if d != now:
                        now, own = d, np.unique(hashes[edges[d] : edges[d + 1]])
                    item = known.sets[i]
                    at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                    shared = int((own[at] == item).sum())
                    if shared * 100 >= percent * len(item):
                        found.append((d, int(known.names[i]), len(item), shared))
                ids = part.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3))], names=["doc_id", "item_id", "item_shingles", "shared"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Items of which a document holds at least ``percent`` of the shingles.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` ``item_id`` and
    ``text``; other columns are ignored. Texts become sets of ``n``-word
    shingles of lower-cased (A-Z) words, a shorter text its whole sequence,
    which only an equal whole text holds. Null and wordless texts, and items
    without id, hold nothing and are never found. Of repeated item ids each
    text's shingles join one set. Returns one row per (document, item), equal
    rows once, so repeated documents too: ``doc_id``, ``item_id``,
    ``item_shingles``, ``shared``, ``containment``. An empty table of either
    gives no rows.

    Items are dealt by their id into blocks of about ``block_shingles``
    shingles; every block is one pass over the documents.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = stored(listed.mapInArrow(_item_rows(n), "item_id long, shingle long").distinct(), "items")
    blocks = -(-rows.count() // block_shingles)
    found = spark.createDataFrame([], _SCHEMA)
    for k in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toPandas()  # one block's shingles
        if len(got):
            known = spark.sparkContext.broadcast(_Items(got.item_id.to_numpy(), got.shingle.to_numpy().view(np.uint64)))
            found = found.union(texts.mapInArrow(_search(known, n, percent), _SCHEMA))
    return found.distinct().withColumn("containment", F.col("shared") / F.col("item_shingles"))
