"""The operators on small tables: odd rows, brute force, defined results."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quillrank.llm import decontamination, fingerprints, mixing, near_dedup, quality, sharding, skew, substring_dedup, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, component_id string, kept int"


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def corpus():
    """Exact and near copies, a shared passage, hot group, nulls, empties, repeats."""
    base, other, shared = words(120, 1), words(90, 2), words(60, 3)
    edited, chain = list(base), list(base)
    edited[60] = "changed"
    chain[60] = "changed"
    chain[10] = "again"
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(edited).upper()), (4, " ".join(chain)), (5, None), (6, ""), (7, "  \n"), (8, "two words"), (9, "TWO  words"), (10, " ".join(other[:40] + shared + other[40:]))]
    rows += [(11, " ".join(words(50, 4) + shared)), (12, " ".join(shared + words(70, 5))), (13, "<|endoftext|> x"), (14, " ".join(words(3000, 6))), (15, "x" * 20000)]
    rows += [(100 + i, " ".join(base)) for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 7 else f"s{i % 4}", 0, "x", "y", "z", 1) for i, t in corpus()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = plain(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, n):
    sets, home = {i: shingles(t, n) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                home[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, n):
    want, sets = components(corpus(), n)
    rows = near_dedup.near_duplicates(docs, n=n).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in rows} == {i: (want[i], len(sets[i]), want[i] == i) for i in want}


def test_near_duplicates_without_a_common_pivot(spark):
    """Members that differ from the bucket's pivot but not from each other."""
    base = words(200, 9)
    rows = []
    for i in range(30):
        rng = random.Random(i)
        w = list(base)
        for k in rng.sample(range(200), i // 3):
            w[k] = f"e{i // 2}x{k}"
        rows.append((i, " ".join(w)))
    want, _ = components(rows, 5)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_duplicates_of_odd_tables(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    t, u = " ".join(words(40, 1)), " ".join(words(40, 2))
    rows = [(4, t), (4, t), (3, t), (None, t), (7, u), (9, None), (8, "")]
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("3", 3, True), ("4", 3, False), ("4", 3, False), ("7", 7, True), ("8", 8, True), ("9", 9, True), ("None", None, True)]


def test_near_copies_in_one_large_bucket(spark):
    """Hundreds of near copies of one text, many of which link with few others."""
    base, rows = words(150, 31), []
    for i in range(300):
        rng = random.Random(i)
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(0, 14)):
            w[k] = rng.choice(["red", "blue", f"e{i}x{k}"])
        rows.append((i, " ".join(w)))
    want, _ = components(rows, 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 3


def test_near_copies_make_few_pairs(spark, monkeypatch):
    """Members of one large bucket that cannot link are not laid over each other."""
    base, rows = words(150, 31), []
    for i in range(600):
        rng = random.Random(i)
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(4, 14)):
            w[k] = rng.choice(["red", "blue", "green"])
        rows.append((i, " ".join(w)))
    made = []
    for name in ("_alike", "_confirmed"):
        step = getattr(near_dedup, name)
        monkeypatch.setattr(near_dedup, name, lambda pairs, *more, step=step: made.append(pairs.count()) or step(pairs, *more))
    want, _ = components(rows, 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 100
    assert sum(made) < near_dedup.BANDS * len(rows)


def test_open_buckets_join_by_their_rarest_shingles_only(spark, monkeypatch):
    """No join reads all shingles of the members of open buckets, whether or not one is very common."""
    base, rows = words(600, 33), []
    for i in range(200):
        rng = random.Random(i)
        w = list(base)
        for k in rng.sample(range(600), rng.randrange(16, 56)):
            w[k] = rng.choice(["red", "blue", "green"])
        rows.append((i, " ".join(w)))
    read, step = [], near_dedup.join_facts
    monkeypatch.setattr(near_dedup, "join_facts", lambda rows, *more: read.append(rows.count()) or step(rows, *more))
    want, sets = components(rows, 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 3
    assert max(read) < sum(map(len, sets.values())) / 3


@pytest.mark.parametrize("cells", [1, 1 << 6, 1 << 18])
def test_rarest_shingles_meet_at_any_order(cells, monkeypatch):
    """Sets at the similarity share a listed shingle whose place allows it, however coarse the counts."""
    monkeypatch.setattr(near_dedup, "CELLS", cells)
    monkeypatch.setattr(near_dedup, "CELL_BLOCK", min(cells, 1 << 4))
    rng, sets = np.random.default_rng(5), []
    for n in (1, 2, 4, 5, 10, 47, 100, 201):
        for _ in range(6):
            own = rng.integers(-(2**63), 2**63 - 1, n)
            gone = rng.permutation(n)[: n // 9]
            sets += [np.unique(own), np.unique(np.append(np.delete(own, gone), rng.integers(-(2**63), 2**63 - 1, len(gone))))]
    ids = pa.array(range(len(sets)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(sets, pa.list_(pa.int64()))], names=["rep", "component", "shingles"])
    half = len(sets) // 2
    parts = pa.Table.from_batches([x for part in (batch.slice(0, half), batch.slice(half)) for x in near_dedup._tallied([part])])
    tally = np.zeros((cells // near_dedup.CELL_BLOCK, near_dedup.CELL_BLOCK), np.int64)
    for block in set(parts["block"].to_pylist()):
        own = near_dedup._summed(parts.filter(pc.equal(parts["block"], block)))
        tally[block] = np.frombuffer(own["tally"][0].as_py(), np.int64)
    assert tally.sum() == sum(map(len, sets))
    listed = {}
    for part in near_dedup._rarest(tally.ravel(), 80)([batch]):
        for row in part.to_pylist():
            listed.setdefault(row["rep"], {})[row["s"]] = (row["left"], row["n"])
    for i in range(0, len(sets), 2):
        x, y, shared = listed.get(i, {}), listed.get(i + 1, {}), len(np.intersect1d(sets[i], sets[i + 1]))
        assert 100 * shared >= 80 * (len(sets[i]) + len(sets[i + 1]) - shared)
        assert any(180 * min(x[s][0], y[s][0]) >= 80 * (x[s][1] + y[s][1]) for s in x.keys() & y.keys())


def test_recall_at_the_threshold(spark):
    """Pairs just at similarity 0.8: bands and sketches together lose none of 1500."""
    rows = []
    for k in range(1500):
        w = words(94, f"r{k}")
        edited = list(w)
        for at in (10, 60) if k % 2 else (5, 80):
            edited[at] = "other"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(edited))]
    near = [100 * len(a & b) / len(a | b) for a, b in ((shingles(rows[i][1], 5), shingles(rows[i + 1][1], 5)) for i in range(0, 3000, 2))]
    assert min(near) >= 80 and max(near) < 81
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r["component_id"] != r["doc_id"] - r["doc_id"] % 2 for r in got) == 0


def test_contained_items(spark, docs, empty):
    items = spark.createDataFrame([(0, " ".join(words(60, 3))), (1, " ".join(words(30, 77))), (2, None), (3, ""), (4, "two words"), (5, " ".join(words(120, 1)[30:80]))], "item_id long, text string")
    want = set()
    for i, t in corpus():
        for j, s in ((r["item_id"], r["text"]) for r in items.collect()):
            a, b = shingles(t, 5), shingles(s, 5)
            if b and 100 * len(a & b) >= 80 * len(b):
                want.add((i, j, len(b), len(a & b)))
    for limit in (10**6, 40):
        got = decontamination.contained_items(docs, items, block_shingles=limit).collect()
        assert {(r["doc_id"], r["item_id"], r["item_shingles"], r["shared"]) for r in got} == want
    assert decontamination.contained_items(empty, items).count() == decontamination.contained_items(docs, items.limit(0)).count() == 0


def test_containment_recall(spark):
    """Items of every size, scattered over long documents with a fifth missing."""
    rng, docs_, items, want = random.Random(6), [], [], set()
    for k in range(300):
        n = rng.randrange(1, 150)
        item = words(n + 4, f"i{k}")
        items.append((k, " ".join(item)))
        doc, at = words(rng.randrange(0, 40), f"d{k}"), 0
        while at < len(item):
            size = rng.randrange(20, 60) if n > 40 else len(item)
            doc += item[max(0, at - 4) : at + size] + words(rng.randrange(5, 400), f"d{k}x{at}")
            at += size + (1 if n > 40 else 0)
        docs_.append((k, " ".join(doc)))
        a, b = shingles(docs_[-1][1], 5), shingles(items[-1][1], 5)
        if 100 * len(a & b) >= 80 * len(b):
            want.add((k, k))
    got = decontamination.contained_items(spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 250


def test_repeated_items_and_documents(spark):
    t, u = " ".join(words(30, 1)), " ".join(words(30, 2))
    items = spark.createDataFrame([(1, t), (1, t), (2, u), (2, t), (None, t)], "item_id long, text string")
    docs_ = spark.createDataFrame([(5, f"{t} {u}"), (5, f"{t} {u}"), (6, t), (None, u), (7, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"], r["item_shingles"]) for r in decontamination.contained_items(docs_, items).collect())
    assert got == [("5", 1, 26), ("5", 2, 52), ("6", 1, 26)]


def test_repeated_passages(docs, empty):
    assert substring_dedup.repeated_passages(empty).count() == 0
    rows = substring_dedup.repeated_passages(docs).collect()
    texts = dict(corpus())
    places = defaultdict(set)
    for i, t in corpus():
        w = plain(t)
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].add((i, k))
    need = {i for s in places.values() if len({i for i, _ in s}) > 1 for i, _ in s}
    assert need <= {r["doc_id"] for r in rows} and {5, 6, 7, 8, 9, 13, 14, 15}.isdisjoint({r["doc_id"] for r in rows})
    for r in rows:
        a = shingles(" ".join(x.decode() for x in plain(texts[r["doc_id"]])[r["start_word"] : r["start_word"] + r["n_words"]]), 5)
        b = shingles(" ".join(x.decode() for x in plain(texts[r["other_id"]])[r["other_start"] : r["other_start"] + r["other_words"]]), 5)
        assert abs(len(a & b) / len(a | b) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8


def covered(rows, doc, low, high):
    """Words of [low, high) that the rows of ``doc`` cover, over the length."""
    seen = set()
    for start, n in rows[doc]:
        seen |= set(range(start, start + n))
    return len(seen & set(range(low, high))) / (high - low)


def passages_of(spark, texts):
    rows = defaultdict(list)
    for r in substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect():
        rows[r["doc_id"]].append((r["start_word"], r["n_words"]))
    return rows


def test_passage_behind_an_earlier_fragment(spark):
    """The pivot holds 40 of the passage's 50 words first and the whole passage later."""
    texts = []
    for k in range(150):
        p, w = words(50, f"p{k}"), [words(60, f"{x}{k}") for x in "abcde"]
        texts.append((2 * k, " ".join(w[0] + p[5:45] + w[1] + p + w[2])))
        texts.append((2 * k + 1, " ".join(w[3] + p + w[4])))
    rows = passages_of(spark, texts)
    assert [k for k in range(150) if covered(rows, 2 * k + 1, 60, 110) < 0.9 or covered(rows, 2 * k, 160, 210) < 0.9] == []


def test_exact_passage_beside_drifted_variants(spark):
    """Variants of smaller id, two edits in 50 words each, do not hide an exact passage."""
    texts = []
    for k in range(150):
        p, rng = words(50, f"q{k}"), random.Random(k)
        for v in range(5):
            own = list(p)
            if v < 3:
                for at, low in ((rng.randrange(8, 20), 0), (rng.randrange(30, 42), 1)):
                    own[at] = f"edit{v}x{low}"
            texts.append((5 * k + v, " ".join(words(60, f"l{k}x{v}") + own + words(60, f"r{k}x{v}"))))
    rows = passages_of(spark, texts)
    assert [k for k in range(150) if min(covered(rows, 5 * k + v, 60, 110) for v in (3, 4)) < 1] == []


def test_near_passage_beside_drifted_variants(spark):
    """Texts whose edited passage only resembles each other's, beside earlier texts with fragments of it."""
    rows = []
    for k in range(40):
        base = words(70, f"n{k}")
        for i in range(6):  # fragments of 40 words
            rows.append((1000 * i + k, " ".join(words(30, f"a{k}x{i}") + base[5 * i : 5 * i + 40] + words(30, f"b{k}x{i}"))))
        for i in (6, 7):
            own = list(base)
            own[35] = f"edit{i}"
            rows.append((1000 * i + k, " ".join(words(30, f"a{k}x{i}") + own + words(30, f"b{k}x{i}"))))
    rows = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["other_id"]) for r in substring_dedup.repeated_passages(rows).collect()}
    assert all((7000 + k, 6000 + k) in got and (6000 + k, 7000 + k) in got for k in range(40))


def test_pivots_that_are_broadcast_are_bounded(spark, monkeypatch):
    """Texts that share a line of 44 words choose pivots in turns; near passages among them are found all the same."""
    line, rows = words(44, "line"), []
    for i in range(12):
        base = words(40, f"t{i}")
        for k in range(2):
            own = list(base)
            own[5] = f"edit{k}"
            rows.append((12 * k + i, " ".join(line + own + words(30, f"t{i}x{k}"))))
    rows = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    most, step = [], substring_dedup.join_facts

    def counted(rows, facts, key, size, total):
        if "theirs" in facts.columns and "bits" in str(facts.schema["theirs"]):
            listed = facts.where(F.col(size) * skew.HOT > total).select(F.size("theirs").alias("n"), F.lit(1).alias("marks"))
            most.append(listed.agg(F.sum("n"), F.count("marks")).first())
        return step(rows, facts, key, size, total)

    monkeypatch.setattr(substring_dedup, "join_facts", counted)
    want = {tuple(r) for r in substring_dedup.repeated_passages(rows).collect()}
    assert all((12 + i, i) in {(r[0], r[3]) for r in want} for i in range(12))
    rounds = len(most)
    monkeypatch.setattr(substring_dedup, "BROADCAST_PIVOTS", 100, raising=False)
    got = {tuple(r) for r in substring_dedup.repeated_passages(rows).collect()}
    assert {(r[0], r[3]) for r in got} == {(r[0], r[3]) for r in want}
    assert any((n or 0) > max(100, marks) for n, marks in most[:rounds])
    assert all((n or 0) <= max(100, marks) for n, marks in most[rounds:])


def test_unexplained_members_meet_by_their_rarest_shingles_only(spark, monkeypatch):
    """No join reads all shingles around the windows of texts that share a line; however they are counted, the same texts meet."""
    line, rows = words(44, "line"), []
    for i in range(12):
        base = words(40, f"t{i}")
        for k in range(2):
            own = list(base)
            own[5] = f"edit{k}"
            rows.append((12 * k + i, " ".join(line + own + words(30, f"t{i}x{k}"))))
    rows = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    around, read, step, keep = [], [], substring_dedup.join_facts, substring_dedup.stored

    def kept(df, label):
        if label == "around":
            around.append(df.agg(F.sum(F.size("near"))).first()[0])
        return keep(df, label)

    def joined(rows, facts, key, *more):
        if key == "mark":
            read.append(rows.count())
        return step(rows, facts, key, *more)

    monkeypatch.setattr(substring_dedup, "stored", kept)
    monkeypatch.setattr(substring_dedup, "join_facts", joined)
    want = {(r[0], r[3]) for r in substring_dedup.repeated_passages(rows).collect()}
    assert all((12 + i, i) in want for i in range(12)) and max(read) < around[0] / 2
    read.clear()
    monkeypatch.setattr(substring_dedup, "GROUP", 4, raising=False)
    assert {(r[0], r[3]) for r in substring_dedup.repeated_passages(rows).collect()} == want
    assert max(read) < around[1] / 2


def test_windows_that_meet_no_other_are_not_moved(spark, monkeypatch):
    shared = words(60, "same")
    rows = [(i, " ".join(words(200, f"u{i}") + (shared if i < 2 else []))) for i in range(40)]
    moved, step = [], substring_dedup.with_facts
    monkeypatch.setattr(substring_dedup, "with_facts", lambda rows, facts, key, *more: (moved.append(rows.count()) if key == "key" else None) or step(rows, facts, key, *more))
    got = passages_of(spark, rows)
    assert covered(got, 0, 200, 260) == covered(got, 1, 200, 260) == 1
    assert 0 < moved[0] < 40


def test_keys_that_occur_again_keep_their_bit():
    """In one part or in several, wherever in the range of keys."""
    rng = np.random.default_rng(3)
    once = rng.integers(0, 2**64, 20_000, np.uint64, endpoint=False)
    again = np.append(rng.integers(0, 2**64, 500, np.uint64, endpoint=False), np.array([0, 2**64 - 1], np.uint64))
    parts = [substring_dedup._packed(np.concatenate(x)) for x in ((once[:9000], again[:300], again[:300], again[:300]), (once[9000:], again[300:]), (again[300:],))]
    parts = pa.Table.from_batches([*parts, substring_dedup._packed(np.empty(0, np.uint64))])
    bits = np.zeros((substring_dedup.RANGES, substring_dedup.RANGE_BITS // 8), np.uint8)
    for k in set(parts["range"].to_pylist()):
        bits[k] = np.frombuffer(substring_dedup._again(parts.filter(pc.equal(parts["range"], k)))["bits"][0].as_py(), np.uint8)
    bits = np.unpackbits(bits.ravel())
    cell = lambda keys: (keys // np.uint64(2**64 // len(bits))).astype(np.int64)
    assert bits[cell(again)].all() and bits.sum() <= len(again) and bits[cell(once)].sum() < 20


@pytest.mark.parametrize("period", [1, 2, 7, 30])
def test_passages_in_periodic_runs(spark, period):
    """Repeated words or lines, runs of unequal lengths, alone and as the beginning of a passage."""
    w, p = words(period, "line"), words(40, "p")
    ran = {1: 90, 2: 420, 3: 0, 4: 60, 5: 90}
    texts = [(i, " ".join(words(60, f"l{i}") + (w * n)[:n] + (p if i > 3 else []) + words(60, f"r{i}"))) for i, n in ran.items()]
    rows = passages_of(spark, texts)
    # fewer open places than a shingle has are not looked at again
    assert covered(rows, 1, 60, 150) > 0.95 and covered(rows, 2, 60, 480) > 0.95 and not rows[3]
    assert covered(rows, 4, 60, 160) > 0.95 and covered(rows, 5, 90, 190) > 0.95
    assert max(start + n for start, n in rows[2]) <= 495 and min(start for start, _ in rows[2]) >= 45


def test_equal_centres_are_one_entry():
    import numpy as np

    centre = np.array([3, 4, 5, 7, 9, 11, 14, 17, 18])
    key, text = np.array([1, 1, 2, 2, 2, 2, 2, 2, 2]), np.array([0, 0, 0, 0, 0, 0, 0, 0, 1])
    sums = np.cumsum(np.concatenate([[0], [1, 2] * 12])).astype(np.uint64)
    first, last, period = substring_dedup._equal_runs(centre, key, text, sums)
    assert first.tolist() == [0, 2, 6, 7, 8] and last.tolist() == [1, 5, 6, 7, 8] and period.tolist() == [1, 2, 1, 1, 1]
    none = np.empty(0, np.int64)
    assert [len(x) for x in substring_dedup._equal_runs(none, none, none, sums)] == [0, 0, 0]


def test_passages_of_repeated_ids(spark):
    p = words(60, "p")
    rows = [(1, " ".join(words(70, "a") + p)), (1, " ".join(words(70, "a") + p)), (1, " ".join(words(55, "b"))), (2, " ".join(p + words(20, "c"))), (None, " ".join(p))]
    got = {(r["doc_id"], r["other_id"], r["n_words"]) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2, 60), (2, 1, 60)}


def test_windows_of_texts_beyond_a_segment(monkeypatch):
    import numpy as np

    values = np.random.Generator(np.random.PCG64(1)).integers(0, 900, 5000).astype(np.uint64)
    edges, salt = np.array([0, 3100, 3120, 5000]), np.uint64(77)
    whole = substring_dedup.compact_windows(values, edges, salt)
    monkeypatch.setattr(substring_dedup, "SEGMENT", 256)
    assert all((a == b).all() for a, b in zip(whole, substring_dedup.compact_windows(values, edges, salt), strict=True))


def test_edits_leave_a_long_aligned_run():
    """A passage at similarity 0.8 has ALIGNED places in one alignment at least."""
    rng = random.Random(12)
    tried = 0
    for _ in range(4000):
        own = list(range(rng.randrange(50, 150)))
        other = list(own)
        for _ in range(rng.randrange(0, 6)):
            at, kind = rng.randrange(len(other)), rng.randrange(4)
            if kind == 0:
                other[at] = -rng.randrange(1, 10**6)
            elif kind == 1:
                del other[at]
            elif kind == 2:
                other.insert(at, -rng.randrange(1, 10**6))
            else:
                to = rng.randrange(len(other))
                part = other[at : at + 12]
                other[at : at + 12] = []
                other[to:to] = part
        a, b = ([tuple(x[i : i + 5]) for i in range(len(x) - 4)] for x in (own, other))
        if min(len(a), len(b)) >= substring_dedup.LEAST and len(set(a) & set(b)) * 100 >= 80 * len(set(a) | set(b)):
            tried += 1
            shifts = Counter(i - b.index(x) for i, x in enumerate(a) if x in b)
            assert max(shifts.values()) >= substring_dedup.ALIGNED
    assert tried > 1000


def test_fingerprints(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 8)
    rows = sorted(fingerprints.fingerprint_edits(docs).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for _, t in corpus()]
    roots = {}
    for k, r in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert roots.setdefault(t, r["fingerprint"]) == r["fingerprint"] and roots.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert (r["near_next"] == 1.0) == (t == after) and 0 <= r["near_edited"] <= 1
    assert len(set(roots.values())) == len(roots)
    assert fingerprints.fingerprint_edits(empty).count() == 0
    one = fingerprints.fingerprint_edits(docs.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0
    pair = spark.createDataFrame([("a\nb\n\nc", "a\nB\n\nc")], "x string, y string")
    again = docs.union(docs.where("doc_id in (1, 6)")).union(docs.where("doc_id = 1").withColumn("text", F.lit("unequal")))
    twice = [sorted(map(str, fingerprints.fingerprint_edits(d).collect())) for d in (again, again.repartition(7))]
    assert len(twice[0]) == again.count() and twice[0] == twice[1]
    both = fingerprints.fingerprints(fingerprints.fingerprints(pair, "x").withColumnRenamed("tree", "p"), "y")
    assert both.select(fingerprints.differing(F.col("p"), F.col("tree")).alias("d")).first()["d"] == [1]


def leaves(line):
    return re.findall(r"[^.!?]{0,15}[.!?]|[^.!?]{1,16}", line)


def test_likeness_against_brute_force(spark):
    """Weighted Dice of all nodes as multisets; only equal texts have 1."""
    rng = random.Random(4)
    texts = ["", "a.b.a.b.", "a.b.", "b.a.", "x\n\ny", "y\n\nx", "same words " * 30, "same words " * 31, "\n", "é" * 40]
    texts += ["\n".join(" ".join(rng.choice(["one", "two.", "three", "four!"]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))) for _ in range(10)]
    pairs = [(a, b) for a in texts for b in texts]
    both = fingerprints.with_tree(fingerprints.with_tree(spark.createDataFrame(pairs, "a string, b string"), F.col("a"), "p"), F.col("b"), "q")
    names = ["a", "b", "p_paragraphs", "p_sections", "p_root", "q_paragraphs", "q_sections", "q_root"]
    for r in both.select(*names, fingerprints.likeness(F.col("p_marks"), F.col("q_marks")).alias("near")).collect():
        x, y = (
            Counter((leaf, len(leaf)) for line in r[t].split("\n") for leaf in leaves(line)) + Counter((p, 1) for p in [*r[f"{k}_paragraphs"], *(("s", s) for s in r[f"{k}_sections"]), ("root", r[f"{k}_root"])])
            for t, k in (("a", "p"), ("b", "q"))
        )
        weigh = lambda c: sum(node[1] * n for node, n in c.items())
        assert r["near"] == pytest.approx(2 * weigh(x & y) / (weigh(x) + weigh(y))) and (r["near"] == 1) == (r["a"] == r["b"])


def test_mix(docs, empty):
    rows = mixing.entropy_mix(docs).collect()
    sizes = Counter()
    for i, t in corpus():
        sizes[None if i == 7 else f"s{i % 4}"] += len(plain(t))
    order = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= share
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    largest = max(len(plain(t)) for _, t in corpus())
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    assert len(rows) == len(corpus()) and sorted(map(str, rows)) == sorted(map(str, mixing.entropy_mix(docs.repartition(7)).collect()))
    assert mixing.entropy_mix(empty).count() == mixing.mixed_documents(empty).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and Counter(r["doc_id"] for r in whole.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def dense_rates(sizes, target, cap=2.0):
    """min(cap, exp(lambda * size)) that meets the target, by bisection."""
    low, high = math.log(target / sum(sizes)) if target < sum(sizes) else 0.0, math.log(cap)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(cap, math.exp(min(mid * s, 50))) * s for s in sizes) < target:
            low = mid
        else:
            high = mid
    return [min(cap, math.exp(min(low * s, 50))) for s in sizes]


def test_mix_rates_balance(spark):
    """Rates differ within a source and equal those of a dense solver."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), f"s{i % 4}") for i in range(800)]
    got = mixing.entropy_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("s0", "s1", "s2", "s3"):
        own = sorted((r for r in got if r["source"] == source), key=lambda r: r["doc_id"])
        if own[0]["target"] < 2 * own[0]["source_size"] - 1e-6:
            want = dense_rates([r["size"] for r in own], own[0]["target"])
            assert [r["rate"] for r in own] == pytest.approx(want, rel=1e-5) and max(want) - min(want) > 0.1
        else:
            assert {r["rate"] for r in own if r["size"]} == {2.0}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3 and all(r["copies"] <= 2 for r in own)


def test_mix_repeated_rows(spark):
    """Rows of one id are documents of their own; the copies are the mix's."""
    rows = [(1, "a b c d e", "s", "x")] * 60 + [(2 + i // 2, f"t{i} " * (1 + i % 7), "s" if i % 2 else None, "y") for i in range(100)] + [(None, "a b", "s", "z"), (None, None, None, None)] + [(1, "a b c d e", "s", "other")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")
    mix = mixing.entropy_mix(docs).collect()
    assert len(mix) == len(rows)
    want = Counter()
    for r in mix:
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    for deal in (1, 5):
        got = Counter((r["doc_id"], r["source"], len(plain(r["text"]))) for r in mixing.mixed_documents(docs.repartition(deal)).collect())
        assert got == +want
    assert max(Counter((r["doc_id"], r["text"], r["rate"]) for r in mixing.mixed_documents(docs).collect()).values()) <= 120


def test_shards(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(corpus())
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    texts = dict(corpus())
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 for r in rows)
    assert sharding.shard_documents(empty).count() == 0
    again = docs.union(docs.where("doc_id < 9"))
    first, second = ([tuple(r) for r in sharding.shard_documents(d).collect()] for d in (again.repartition(5), again.repartition(2, "source")))
    assert len(first) == again.count() and sorted(map(str, first)) == sorted(map(str, second))


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i % 300}" if i < 600 else f"alone {i}") for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    homes = defaultdict(set)
    for r in got:
        if r["doc_id"] < 600:
            homes[r["doc_id"] % 300].add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) <= 15


def test_token_counts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, path).collect()}
    for i, t in corpus():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)


def test_token_counts_of_odd_tables(spark, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.token_counts(empty, path).count() == 0
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    counter, library = token_counts.Counter(path), Tokenizer.from_file(path)
    for t in ["", "x" * 5000, "zqxj wvkq " * 20, "é漢字" * 300, "<|endoftext|> a", "x" * 5000]:
        assert counter.counts([t, t]) == [len(library.encode(t, add_special_tokens=False).ids)] * 2 and counter.held <= 50 + 4 * len(t)


def test_archives_of_repeated_pages(spark, tmp_path):
    rows = [(3, "u", "z" * 200), (3, "u", "z" * 200), (5, "v", "z" * 200), (None, "w", "z" * 200)] + [(10 + i, "h", "q" * 150) for i in range(50)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/r")).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    want = Counter({(3, "response", None): 2, (5, "revisit", 3): 1, (None, "revisit", 3): 1, (10, "response", None): 1}) + Counter((11 + i, "revisit", 10) for i in range(49))
    assert kinds == want


def test_archives(spark, tmp_path):
    html = {1: "<p>" + "a" * 200, 2: "<p>" + "a" * 200, 3: "short", 4: "short", 5: None, 6: "", 7: "é" * 60, 0: "<p>" + "a" * 200}
    pages = spark.createDataFrame([(i, f"http://x/{i}" if i else None, h, "clash") for i, h in html.items()], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(pages, f"file://{tmp_path}/w")
    rows = {r["page_id"]: r for r in warc.read_archives(archives, payloads=True).collect()}
    for i, h in html.items():
        data = (h or "").encode()
        assert (rows[i]["payload_bytes"], rows[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == (("revisit", 0) if i in (1, 2) else ("response", None))
        assert rows[i]["payload"] == (None if i in (1, 2) else data)
    path = archives.first()["archive"].removeprefix("file://")
    with open(path, "rb") as f:
        whole = f.read()
    assert int.from_bytes(whole[:4], "little") == warc.DICTIONARY_FRAME
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(whole[:-3])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(whole[8:])))
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_quality(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(["the", "house", "stands", "near", "river", "and", "trees"]) for _ in range(rng.randrange(20, 90))]
        bad = i % 4 == 0
        rows.append((i, " | ".join(w) if bad else " ".join(w) + ".", "l", "s", "clash"))
        labels.append((i, 0 if bad else 1, None))
    docs = spark.createDataFrame([*rows, (900, None, "l", "s", "c"), (901, "", "l", "s", "c"), (901, "", "l", "s", "c"), (902, "word " * 50000, "l", "s", "c")], "doc_id long, text string, lang string, source string, score string")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labelled)
    got = quality.quality_scores(docs, model).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 500]
    assert len(got) == 504 and sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"] < 500} == {r["doc_id"] for r in got if r["predicted"] and r["doc_id"] < 500}
    constant = quality.fit_quality(docs, labelled.limit(0))
    assert {r["score"] for r in quality.quality_scores(docs.limit(3), constant).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs.limit(3), toxicity.fit_toxicity(docs, labelled)).count() == 3


def test_quality_keeps_labels_shares_above_the_bound(spark):
    """Texts that tell nothing of their class score the labels' share, bounded or not."""
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng.randrange(20, 60), f"t{i}"))) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, int(i % 8 != 0)) for i, _ in rows], "doc_id long, quality int")
    means = []
    for bound in (6000, 120):
        model = quality.fit_quality(docs, labelled, rows=bound)
        means.append(quality.quality_scores(docs, model).agg(F.avg("score")).first()[0])
    assert means[0] == pytest.approx(0.875, abs=0.04) and means[1] == pytest.approx(0.875, abs=0.04)


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_labels_change_no_score(spark):
    """Labels of held-out rows, repeated ids and extra rows do not reach either fit."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "day", "to", "you", "all"] + (["vile", "scum"] if i % 3 == 0 else [])) for _ in range(rng.randrange(5, 60)))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 4 != 0), int(i % 3 == 0)) for i, _ in rows]
    flipped = [(i, 1 - q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    results = []
    for some in (labels, flipped):
        table = spark.createDataFrame(some, "doc_id long, quality int, toxic int")
        scores = [quality.quality_scores(docs, quality.fit_quality(docs, table)), toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, table))]
        results.append([sorted((r["doc_id"], r["held_out"], r["score"]) for r in s.collect()) for s in scores])
    assert results[0] == results[1] and all(r[1] == held(r[0]) for part in results[0] for r in part)


def test_toxicity(spark, empty):
    """A fitted network finds a toxic stretch anywhere, in long labelled texts too."""
    rng = random.Random(5)
    calm = ["the", "house", "stands", "near", "a", "river", "with", "trees", "and", "birds"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(calm) for _ in range(rng.randrange(20, 160) if i % 40 else 9000)]
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(["vile", "scum", "filth", "idiots"]) for _ in range(8)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (901, ""), (None, "birds")], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, table)
    got = toxicity.toxicity_scores(docs, model).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 for r in got)
    own = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in own) / len(own) > 0.95
    assert {r["predicted"] for r in got if r["doc_id"] in (900, 901)} == {0}
    assert toxicity.toxicity_scores(empty, model).count() == 0
    assert quality.quality_scores(empty, quality.fit_quality(empty, table.withColumn("quality", F.col("toxic")))).count() == 0


def test_window_scores_against_a_plain_network():
    """The vectorised network equals a step-by-step one; a text's logit is its largest window's."""
    import numpy as np
    import pyarrow as pa

    from quillrank.llm.words import Words

    p = toxicity._start()
    rng = np.random.Generator(np.random.PCG64(2))
    odds = toxicity.Odds(rng.normal(size=toxicity.GRAMS).astype(np.float32), rng.normal(size=toxicity.BUCKETS).astype(np.float32))
    model = toxicity.ToxicityModel(p, odds, (1.0, 0.0, 0.0))
    w = Words(pa.array([" ".join(words(n, n)) for n in (1, 5, 32, 33, 90)]))
    first, many, of = toxicity.windows_of(w)
    x, _ = toxicity._inputs(w, np.arange(len(w.start)), p, odds)
    want = []
    for f, m in zip(first, many, strict=True):
        states = []
        for d, own in (("f", x[f : f + m]), ("b", x[f : f + m][::-1])):
            h, out = np.zeros(toxicity.HIDDEN), []
            for v in own:
                a, b = v @ p[f"w{d}"] + p[f"b{d}"], h @ p[f"u{d}"]
                k = toxicity.HIDDEN
                z, r = 1 / (1 + np.exp(-(a[:k] + b[:k]))), 1 / (1 + np.exp(-(a[k : 2 * k] + b[k : 2 * k])))
                h = (1 - z) * np.tanh(a[2 * k :] + r * b[2 * k :]) + z * h
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        both = np.hstack(states)
        weight = np.exp(np.tanh(both @ p["wa"]) @ p["va"])
        want.append((weight / weight.sum()) @ both @ p["wo"] + p["bo"][0])
    assert np.allclose(model.window_logits(w, first, many), want, atol=1e-4)
    best, count = model.logits(w)
    assert np.allclose(best, [max(np.array(want)[of == t]) for t in range(5)], atol=1e-4) and count.tolist() == np.bincount(of).tolist()


def test_quality_scores_against_plain_sums(spark):
    """Ridge weights equal those of the whole normal equations, solved at once."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["so", "it", "goes", "!!", "ON"][: 3 + 2 * (i % 2)]) for _ in range(rng.randrange(5, 50)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int"))
    own = [(i, t) for i, t in rows if not held(i)]
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)).alias("f")).collect()}
    fit = [(i, t) for i, t in own if fold[i] != 0]
    z = model.mapped(quality.statistics(pa.array([t for _, t in fit])))
    y = np.array([1.0 - i % 2 for i, _ in fit])
    want = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-3)
