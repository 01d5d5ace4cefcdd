"""MinHash near-deduplication verified through odd sketches.

Every text becomes its set of word shingles. ``BANDS * ROWS`` MinHash samples
give band keys (candidates share one) and are folded into an odd sketch: one
parity bit per sample's slot. The population count of two sketches' XOR
estimates their similarity so well near 1 that pairs far below the threshold
are dropped without looking at the sets; every link is confirmed on full sets.

Equal sets collapse first; every band bucket then compares its members with one
pivot, the member that meets most others over all buckets. The members of
buckets that these links leave in several components meet once more by exact
prefix filtering: two alike sets share one of their rarest shingles, and where
it stands in both bounds what they can share. Only members of different
components that pass these bounds and the sketches become pairs.

Two steps are random, with fixed seeds: a pair at similarity 0.8 shares none of
the 36 bands of 5 with probability 6e-7, and the sketches of such a pair differ
in more than ``SKETCH_LIMIT`` bits with probability below 1e-8. The tests
measure both together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .skew import join_facts
from .storage import stored
from .words import Words, chunks, mixed

#: 36 bands of 5 rows lose a pair at similarity 0.8 with probability 6e-7.
BANDS, ROWS = 36, 5
SKETCH_WORDS = 8
#: Most differing sketch bits of a candidate: 63 are expected at similarity
#: 0.8 with a deviation of about 8.5; 114 is six deviations above.
SKETCH_LIMIT = 114
#: Members of one shingle that a task lays over others at once, about.
BLOCK = 1024
#: Cells whose counts order the shingles, rarest first, and those in one row of counts.
CELLS, CELL_BLOCK = 1 << 18, 1 << 12
#: So many ids are broadcast at most; beyond, the texts are joined by shuffle.
BROADCAST_IDS = 500_000

_seeds = np.random.Generator(np.random.PCG64(97))
_MULTIPLY = _seeds.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _seeds.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_BAND_STEP = _seeds.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _seeds.integers(1, 2**63, BANDS, dtype=np.uint64)


def minhashes(distinct: np.ndarray) -> np.ndarray:
    """The smallest value of each of the sample functions over a set of hashes."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(distinct), 2048):
        np.minimum(least, np.multiply.outer(_MULTIPLY, distinct[at : at + 2048]).min(axis=1), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bits of the slots that the samples fall into, as 64-bit words."""
    slots = (mixed(samples ^ _SALT) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=64 * SKETCH_WORDS).astype(np.uint8) & 1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key per band; a key belongs to one band only."""
    return mixed((samples.reshape(BANDS, ROWS) * _BAND_STEP).sum(axis=1, dtype=np.uint64) ^ _BAND_SALT).view(np.int64)


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, many = Words(part.column("text")).shingles(n)
                sizes, keys, bands, sketches = [], [], [], []
                for own in np.split(hashes, np.cumsum(many)[:-1]):
                    own = np.unique(own)
                    sizes.append(len(own))
                    keys.append(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64))
                    samples = minhashes(own) if len(own) else None
                    bands.append([] if samples is None else band_keys(samples))
                    sketches.append([] if samples is None else odd_sketch(samples))
                keys = np.array(keys).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "k0", "k1", "bands", "sketch"],
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, many = Words(part.column("text")).shingles(n)
                sets = [np.unique(own).view(np.int64) for own in np.split(hashes, np.cumsum(many)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return run


def _sketch_bits(a: str, b: str) -> Column:
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_WORDS)]
    return sum(bits[1:], bits[0])


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)``, those whose odd sketches do not rule out a link."""
    left = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(left, "a").join(right, "b").where(_sketch_bits("sketch_a", "sketch_b") <= SKETCH_LIMIT).select("a", "b")


def _sets_of(ids: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``(doc_id, shingles)`` of the listed ``id``, each once."""
    ids = stored(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")
    return stored(wanted.mapInArrow(_sets(n), "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)``, those that reach the similarity on full shingle sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("shared") * 100 >= percent * (F.size("x") + F.size("y") - F.col("shared"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles.view(np.uint64)) % np.uint64(CELLS)).astype(np.int64)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a part's sets fall into each cell, a row per block of cells."""
    tally = np.zeros(CELLS, np.int64)
    for batch in batches:
        for own in batch.column("shingles"):
            np.add.at(tally, _cell(own.values.to_numpy()), 1)
    blocks = tally.reshape(-1, CELL_BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blocks[k].tobytes() for k in some], pa.binary())], names=["block", "tally"])


def _summed(parts: pa.Table) -> pa.Table:
    tally = sum(np.frombuffer(x.as_py(), np.int64) for x in parts.column("tally"))
    return pa.table({"block": parts.column("block")[:1], "tally": pa.array([tally.tobytes()], pa.binary())})


def _rarest(tally: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, component, x in zip(*[batch.column(c) for c in ("rep", "component", "shingles")], strict=True):
                own = x.values.to_numpy()
                n, met = len(own), tally[_cell(own)]
                first = np.lexsort((own, met))[: n - -(-n * percent // 100) + 1]
                at = np.flatnonzero(met[first] > 1)  # the others are in this set only
                arrays = [pa.array(own[first[at]]), *(pa.array(np.full(len(at), k.as_py())) for k in (rep, component)), pa.array(np.full(len(at), n, np.int32)), pa.array((n - at).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["s", "rep", "component", "n", "left"])

    return run


def _prefixes(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(s, rep, component, n, left)`` of each set's rarest shingles.

    In any one order of all shingles, two sets that reach the similarity share
    one of their first ``n - ceil(percent * n / 100) + 1`` shingles each. The
    order here is by the count of a shingle's cell (``CELLS`` of them, a hash
    each), so no shingle is listed or counted by itself before the rarest are
    chosen; shingles that share a cell only lie later than they might. ``left``
    counts a set's shingles from ``s`` on.
    """
    tallies = sets.select("shingles").mapInArrow(_tallied, "block long, tally binary").groupBy("block").applyInArrow(_summed, "block long, tally binary")
    tally = np.zeros((CELLS // CELL_BLOCK, CELL_BLOCK), np.int64)
    for row in tallies.collect():
        tally[row["block"]] = np.frombuffer(row["tally"], np.int64)
    grouped = sets.select(F.col("doc_id").alias("rep"), "shingles").join(rest, "rep")
    return grouped.mapInArrow(_rarest(tally.ravel(), percent), "s long, rep long, component long, n int, left int")


def _possible(n: Column, left: Column, n_b: Column, left_b: Column, percent: int) -> Column:
    """Whether two sets that share no shingle before these places may reach the similarity."""
    return F.least(left, left_b) * (100 + percent) >= (n + n_b) * percent


def _crossing(rest: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of ``rest(rep, component)`` that may link two components.

    Shingles keep only members that some member of another component can reach,
    by sizes in grades. Of these, all but those of a shingle's largest
    component are laid over all, in blocks, so the copies within one component
    do not meet.
    """
    prefixes = stored(_prefixes(rest, sets, percent), "prefixes")
    graded = prefixes.groupBy("s", F.floor(F.log("n") / math.log(1.05)).alias("grade"))
    grades = graded.agg(F.min("n").alias("n"), F.max("left").alias("left"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    parts = grades.groupBy("s").agg(F.collect_list(F.struct("n", "left", "low", "high")).alias("parts"), F.sum("members").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))  # grades of sizes: some hundreds at most
    parts = stored(parts.where("low < high").select("s", "parts", "size"), "parts")
    reach = F.exists("parts", lambda p: ((p["low"] != F.col("component")) | (p["high"] != F.col("component"))) & _possible(F.col("n"), F.col("left"), p["n"], p["left"], percent))
    open_ = stored(join_facts(prefixes, parts, "s", "size", prefixes.count()).where(reach).drop("parts", "size"), "open")
    sizes = open_.groupBy("s", "component").agg(F.count("*").alias("members"))
    mains = sizes.groupBy("s").agg(F.max(F.struct("members", "component"))["component"].alias("main"), F.sum("members").alias("size"))
    mains = stored(mains.withColumn("blocks", F.ceil(F.col("size") / BLOCK)), "mains")
    placed = stored(join_facts(open_, mains, "s", "size", open_.count()).join(sketches, "rep"), "placed")
    a = placed.where("component <> main").select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}_a") for c in ("rep", "component", "n", "left", "sketch")])
    b = placed.select("s", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), *[F.col(c).alias(f"{c}_b") for c in ("rep", "component", "n", "left", "sketch")], (F.col("component") == F.col("main")).alias("in_main"))
    apart = (F.col("component_a") != F.col("component_b")) & (F.col("in_main") | (F.col("rep_a") < F.col("rep_b")))
    alike = _possible(F.col("n_a"), F.col("left_a"), F.col("n_b"), F.col("left_b"), percent) & (_sketch_bits("sketch_a", "sketch_b") <= SKETCH_LIMIT)
    met = a.join(b, (a["s"] == b["s"]) & (a["block"] == b["block"]) & apart & alike)
    return met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found(node, component)`` with ``links(u, v)`` added.

    Only links between components are followed, so the work is that of the new links.
    """
    of_u, of_v = (found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    between = links.join(of_u, "u", "left").join(of_v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    roots = stored(connected(between).select(F.col("node").alias("from"), F.col("component").alias("root")), "roots")
    old = found.join(roots, F.col("component") == F.col("from"), "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = roots.join(found, F.col("from") == F.col("node"), "left_anti").select(F.col("from").alias("node"), F.col("root").alias("component"))
    return stored(old.unionByName(fresh), "components")


def _settled(rest: DataFrame, found: DataFrame, texts: DataFrame, sketches: DataFrame, n: int, percent: int) -> DataFrame:
    """``found(node, component)`` joined further by all links between the components of ``rest(rep, component)``."""
    if not rest.limit(1).count():
        return found
    sets = _sets_of(rest.select(F.col("rep").alias("id")), texts, n)
    links = stored(_confirmed(stored(_crossing(rest, sets, sketches, percent), "pairs"), sets, percent), "links")
    return _joined(found, links) if links.limit(1).count() else found


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Classes of near-duplicate documents.

    ``docs`` needs ``doc_id`` (unique) and ``text``; other columns are ignored.
    Words are lower-cased runs (A-Z only) of non-space bytes; a document's set
    is its distinct ``n``-word shingles, its whole sequence where it has fewer
    words. Documents are linked where ``100 * |A & B| >= percent * |A | B|``.

    Returns one row per document: ``doc_id``, ``n_shingles``, ``component_id``
    (the smallest doc_id reachable over links) and ``kept`` (it is that one).
    Null and wordless texts have an empty set and stay alone, as do rows whose
    doc_id is null (component null, kept). Repeated rows of one doc_id keep
    their rows. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, k0 long, k1 long, bands array<long>, sketch array<long>"
    rows = stored(texts.mapInArrow(_signatures(n), schema), "signatures")
    classes = stored(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("k0", "k1").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    entries = classes.select("rep", F.explode("bands").alias("key"))
    shared = stored(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "keys")
    total = shared.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    live = stored(join_facts(entries, shared, "key", "size", total), "entries")
    sketches = classes.select("rep", "sketch")

    degree = live.groupBy("rep").agg(F.sum("size").alias("degree"))
    best = live.join(degree, "rep").groupBy("key", "size").agg(F.max(F.struct("degree", (-F.col("rep")).alias("less"))).alias("best"))
    pivots = stored(best.select("key", "size", (-F.col("best.less")).alias("pivot")), "pivots")
    members = stored(join_facts(live.drop("size"), pivots, "key", "size", total), "members")
    star = members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    star = stored(_alike(star, sketches), "pairs")
    links = stored(_confirmed(star, _sets_of(_ids(star), texts, n), percent), "links")

    found = stored(connected(links), "components")
    placed = stored(members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "members")
    open_keys = placed.groupBy("key", "size").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "size")
    rest = stored(join_facts(placed.drop("size"), open_keys, "key", "size", total).select("rep", "component").distinct(), "rest")
    final = _settled(rest, found, texts, sketches, n, percent).select(F.col("node").alias("rep"), "component")

    homes = classes.select("k0", "k1", "rep").join(final, "rep", "left").select("k0", "k1", F.coalesce("component", "rep").alias("home"))
    linked = rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "k0", "k1").join(homes, ["k0", "k1"])
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("home"))
    out = linked.select("doc_id", "n_shingles", "home").union(alone)
    return out.select("doc_id", "n_shingles", F.col("home").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("home"), F.lit(True)).alias("kept"))
