"""The operators' inner parts against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillrank.llm import near_dedup, quality, substring_dedup, token_counts, toxicity, warc
from quillrank.llm.decontamination import FIRST, partition_of
from quillrank.llm.sharding import granted_moves
from quillrank.llm.words import Words, chunks


def plain_words(text):
    return (text or "").encode().lower().split()


def random_texts(n=60, seed=1):
    rng = random.Random(seed)
    made = [None, "", " \t\n", "One", "one TWO three", "Ünï Çode é", "x" * 3000, "a\x0bb\x0cc\rd"]
    return made + [" ".join(rng.choice(["the", "The", "of", "é", "zz", "Q"]) + rng.choice(["", ".", "\n"]) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_words_and_shingles():
    texts = random_texts()
    w = Words(pa.array(texts, pa.string()).slice(2))
    told = [plain_words(t) for t in texts[2:]]
    assert w.counts.tolist() == [len(x) for x in told]
    ids = {}
    for h, x in zip(w.hashes.tolist(), [y for t in told for y in t], strict=True):
        assert ids.setdefault(x, h) == h
    assert len(set(ids.values())) == len(ids)
    for n in (4, 5):
        hashes, many = w.shingles(n)
        want = [[tuple(t[k : k + n]) for k in range(max(1, len(t) - n + 1))] if t else [] for t in told]
        assert many.tolist() == [len(x) for x in want]
        seen = {}
        for h, x in zip(hashes.tolist(), [y for t in want for y in t], strict=True):
            assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


def test_chunks_cover_everything():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 7 + [None])], names=["text"])
    assert [len(p) for p in chunks(batch, "text", 25)] == [2, 2, 2, 2]


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(0)
    for share, low, high in ((1.0, 0, 0), (0.9, 10, 70), (0.8, 35, near_dedup.SKETCH_LIMIT), (0.0, 150, 512)):
        both = rng.integers(0, 2**63, 600, dtype=np.uint64)
        k = int(600 * share)
        rest = int((600 - k) / 2) if share else 600
        a = np.unique(np.concatenate([both[:k], rng.integers(0, 2**63, rest, dtype=np.uint64)]))
        b = np.unique(np.concatenate([both[:k], rng.integers(0, 2**63, rest, dtype=np.uint64)]))
        bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in near_dedup.odd_sketch(near_dedup.minhashes(a)) ^ near_dedup.odd_sketch(near_dedup.minhashes(b)))
        assert low <= bits <= high


def test_blocks_are_at_most_twice_an_item():
    assert {partition_of(n) for n in range(1, FIRST)} == {1}
    assert all(n < partition_of(n) <= 2 * n for n in range(FIRST, 5000))


def test_compact_windows_partition_all_long_subsequences(monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAST", 4)
    rng = np.random.default_rng(3)
    edges = np.array([0, 30, 33, 60])
    values = rng.integers(0, 12, 60).astype(np.uint64)
    salt = np.uint64(77)
    hashed = substring_dedup.mixed(values ^ salt) & ~substring_dedup._PLACE
    c, left, right = substring_dedup.compact_windows(values, edges, salt)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for i in range(a, b):
            for j in range(i + 3, b):
                centre = i + int(np.argmin(hashed[i : j + 1]))
                assert sum((c == centre) & (left <= i) & (right >= j)) == 1
                assert sum((left <= i) & (right >= j) & (c >= i) & (c <= j)) == 1


def test_passages_are_found_and_verified():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**30, 400).astype(np.int32), rng.integers(0, 2**30, 300).astype(np.int32)
    b[100:160] = a[200:260]
    assert substring_dedup.Pair(a, b).passages(100, 150, 300) == [(200, 260, 100, 160, 1.0)]
    b[100:160:3] = 7
    assert substring_dedup.Pair(a, b).passages(100, 150, 300) == []


def test_isotonic_is_monotone_and_pools():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and x.tolist() == [1, 1, 2, 3, 4, 4] and abs(y[2] - 0.5) < 0.01


def test_statistics_of_any_text():
    stats = quality.statistics(pa.array(random_texts(), pa.string()))
    assert np.isfinite(stats).all() and (stats[0] == stats[1]).all()
    assert len(quality.statistics(pa.array([], pa.string()))) == 0


def test_network_gradients():
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in toxicity._start().items() if k not in ("chars", "words")}
    width = p["wf"].shape[0]
    x = rng.normal(size=(6, width))
    index, mask = rng.integers(0, 6, (5, 3)), np.ones((5, 3), np.float32)
    mask[3:, 1] = 0
    side = np.array([1.0, -2.0, 0.5])

    def value(q):
        projected = {d: x @ q[f"w{d}"] + q[f"b{d}"] for d in "fb"}
        return projected, toxicity._forward(q, projected, index, mask)

    projected, (logit, saved) = value(p)
    g = toxicity._backward(p, projected, index, mask, saved, side)
    for name, grad in (("wo", g["wo"]), ("va", g["va"]), ("wa", g["wa"]), ("uf", g["uf"]), ("ub", g["ub"]), ("wf", x.T @ g["inf"]), ("wb", x.T @ g["inb"])):
        for at in [tuple(rng.integers(0, s) for s in p[name].shape) for _ in range(3)]:
            step = 1e-2
            up, down = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in p.items()}
            up[name][at] += step
            down[name][at] -= step
            numeric = ((value(up)[1][0] - value(down)[1][0]) @ side) / (2 * step)
            assert abs(numeric - grad[at]) < 2e-3 + 0.02 * abs(numeric)
    fast = toxicity._infer({k: v.astype(np.float32) for k, v in p.items()}, {d: v.astype(np.float32) for d, v in projected.items()}, index, mask)
    assert np.allclose(fast, logit, atol=1e-4)


def test_windows_cover_whole_texts():
    w = Words(pa.array([" ".join(["w"] * n) for n in (0, 1, 31, 32, 33, 56, 57, 500)]))
    first, many, of = toxicity.windows_of(w)
    for d, n in enumerate(w.counts):
        covered = {k - w.first[d] for f, m in zip(first[of == d], many[of == d], strict=True) for k in range(f, f + m)}
        assert covered == set(range(n))


def test_toxicity_learns_and_scores_any_text():
    rng = random.Random(0)
    common = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for i in range(240):
        words = [rng.choice(common) for _ in range(rng.randrange(10, 90))]
        if i % 2:
            for _ in range(3):
                words[rng.randrange(len(words))] = "vile" + rng.choice(["ness", "st", "ly", "r", "s"])
        texts.append(" ".join(words))
        y.append(i % 2)
    model = toxicity.train(texts[:180], np.array(y[:180]), 0.5)
    scores = model.scores(pa.array(texts[180:]))
    assert ((scores >= 0.5) == np.array(y[180:])).mean() > 0.9
    odd = model.scores(pa.array([None, "", " ", "word " * 5000, "vileness"], pa.string()))
    assert np.isfinite(odd).all() and (odd >= 0).all() and (odd <= 1).all() and odd[0] == odd[1] == odd[2]
    assert toxicity.train(["a"], np.array([1]), 0.5).scores(pa.array(["b"]))[0] > 0.9


def test_token_counts_match_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = token_counts.Counter(path), Tokenizer.from_file(path)
    rng = random.Random(6)
    texts = ["", " ", "\n\n", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "don't I'LL we're", "x" * 9000, "日本語 ñ é 🎉🎉", "1234567 12", " \t\r\n  end  "]
    texts += ["".join(rng.choice("ab 1.\n\t'sé<|>¼²日 ​_-") for _ in range(rng.randrange(60))) for _ in range(600)]
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_warc_records_round_trip():
    for payload in (b"", b"x" * 99, "é\r\n\r\nWARC/1.1".encode() * 50):
        raw = warc.page_record(3, "http://a/\nb", payload, "d" * 64, None, False, "1970-01-01T00:00:00Z")
        fields, block = warc.parse_record(raw)
        assert fields["WARC-Type"] == "response" and block.partition(b"\r\n\r\n")[2] == payload and fields["Payload-Length"] == str(len(payload))
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-5])


def test_moves_respect_the_limit():
    granted = granted_moves({(0, 1): 50, (1, 0): 20, (2, 1): 40}, [100, 100, 100], 110)
    assert granted == {(0, 1): 30, (1, 0): 20, (2, 1): 0}
