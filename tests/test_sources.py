import json
import random

import pytest
from pyspark.sql import functions as F

from quillrank.config import Models
from quillrank.operators import neural, report, sparse, tuning
from quillrank.operators.index import index_tagged
from quillrank.sources.collections import read_collection, weighted_tokens
from quillrank.sources.runs import dense_texts, read_qrels, read_run, read_topics, write_metadata, write_run, write_tsv
from quillrank.streaming.topics import answer_stream

SAMPLE = "lead text\n<DOC>\n<DOCNO> A-1 </DOCNO>\n<HL> Big-News: Cities & Foxes </HL>\n<DD> = 870324 </DD>\nwell-known cities; AT&T unclosed <b tag\nnext> line\n</DOC>\n<DOC><DOCNO>B2</DOCNO> plain"


def model(tokens):
    """The fields' automaton, one token at a time."""
    closer, boosted, pushed, out = None, False, False, []
    for t in tokens:
        if t in ("<HL>", "</HL>"):
            boosted = t == "<HL>"
            continue
        if pushed:
            pushed = False
            continue
        if t in ("<DOCNO>", "<DD>", "<SO>", "<IN>", "<DATELINE>"):
            closer, pushed = "</" + t[1:], t == "<DOCNO>"
            continue
        if closer:
            closer = None if t == closer else closer
            continue
        if not t.startswith("<"):
            out.append((t, 2 if boosted else 1))
    return out


def test_field_fuzz(spark):
    rng = random.Random(8)
    words = ["<HL>", "</HL>", "<DD>", "</DD>", "<SO>", "</SO>", "<DOCNO>", "</DOCNO>", "<P>", "aa", "bb", "cc", "dd"]
    docs = []
    for i in range(400):
        toks = [rng.choice(words) for _ in range(rng.randrange(25))]
        toks = [t for k, t in enumerate(toks) if not (k and t == "<DOCNO>" and toks[k - 1] == "<DOCNO>")]
        docs.append((i, toks))
    docs = [(i, t) for i, t in docs if not any(a == "<DOCNO>" and b.startswith("<") for a, b in zip([x for x in t if x not in ("<HL>", "</HL>")], [x for x in t if x not in ("<HL>", "</HL>")][1:], strict=False))]
    got = weighted_tokens(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_ord long, text string"))
    rows = {}
    for r in got.orderBy("doc_ord", "pos").collect():
        rows.setdefault(r["doc_ord"], []).append((r["term"], r["weight"]))
    assert all(rows.get(i, []) == model(t) for i, t in docs)


def test_collection(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "b.txt").write_text("<DOC><DOCNO>C3</DOCNO>last")
    (tmp_path / "c" / "a.txt").write_text(SAMPLE)
    docs = read_collection(spark, str(tmp_path / "c"))
    assert [(r["doc_ord"], r["doc_no"]) for r in docs.orderBy("doc_ord").collect()] == [(0, "A-1"), (1, "B2"), (2, "C3")]
    index = index_tagged(docs, weighted_tokens(docs))
    first = index.forward.where("doc_ord = 0").first()
    assert first["terms"] == ["big-new", "city", "fox", "well-known", "city", "at", "t", "unclosed", "next", "line"]
    assert first["doc_len"] == len(first["terms"]) + 3
    tf = index.all_postings().where("term = 'city' and doc_ord = 0").first()["tf"]
    assert tf == 3


def test_text_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("101 zero\n\nno number\n")
    assert [(r["topic_id"], r["words"]) for r in read_topics(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()] == [("101", ["zero"]), ("3", ["no", "number"])]
    (tmp_path / "u.txt").write_text("51 Airbus  subsidies\n52\nplain words\n")
    told = read_topics(spark, str(tmp_path / "u.txt"))
    assert [(r["topic_id"], r["text"]) for r in told.orderBy("line_no").collect()] == [("51", "Airbus subsidies"), ("52", ""), ("3", "plain words")]
    assert {r["topic_id"]: r["text"] for r in dense_texts(told).collect()}["52"] == "52"
    (tmp_path / "q.txt").write_text("1 0 a 1\nbad line\n")
    assert read_qrels(spark, str(tmp_path / "q.txt")).count() == 1
    run = spark.createDataFrame([("2", "x", 1, 0.5), ("10", "y", 1, 1 / 3)], "topic_id string, doc_no string, rank int, score double")
    write_run(run.coalesce(1), str(tmp_path / "run"))
    back = read_run(spark, str(tmp_path / "run"))
    assert {(r["topic_id"], r["score"]) for r in back.collect()} == {("2", 0.5), ("10", 0.3333)}


def test_rewrites(spark):
    cases = [("alpha", "Alpha beta gamma delta epsilon", "alpha beta gamma delta"), ("alpha beta", "beta gamma delta", "beta gamma"), ("alpha beta", "alpha beta", ""), ("alpha beta", "beta alpha", "beta alpha"), ("alpha", "", "")]
    rows = spark.createDataFrame(cases, "q string, a string, w string").select("w", neural.normalised_rewrite(F.col("q"), F.col("a")).alias("g")).collect()
    assert [r["g"] for r in rows] == [r["w"] for r in rows]


def test_cache(spark):
    requests = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k2", "p2")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "old")], "key string, response string")
    got = neural.answered(requests, cache, lambda texts: [f"new {t}" for t in texts]).collect()
    assert sorted((r["key"], r["response"], r["hit"]) for r in got) == [("k1", "old", True), ("k2", "new p2", False), ("k2", "new p2", False)]
    assert neural.answered(requests.where("key = 'k1'"), cache, None).first()["response"] == "old"
    totals = neural.usage(neural.answered(requests, cache, lambda t: ["one two"] * len(t)), "gpt-5-mini").first()
    assert (totals["calls"], totals["hits"], totals["misses"], totals["output_tokens"]) == (3, 1, 2, 5)


def test_embeddings_resume(spark):
    texts = spark.createDataFrame([(0, "a"), (1, ""), (2, "c")], "doc_ord long, doc_text string")
    first = neural.embedded(texts.where("doc_ord = 0"), lambda t: [[3.0, 4.0]] * len(t))
    rest = neural.add_missing_embeddings(texts, first, lambda t: [[0.0, 2.0]] * len(t))
    assert {r["doc_ord"]: [round(x, 3) for x in r["embedding"]] for r in first.union(rest).collect()} == {0: [0.6, 0.8], 1: [0, 0], 2: [0, 1]}


def test_reports(spark, tmp_path):
    for branch, stamp, value in (("original", "20260101-000000", "0.2"), ("new", "20260102-000000", "0.1"), ("new", "20260103-000000", "0.25")):
        (tmp_path / "r" / branch).mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / branch / f"eval-{stamp}.txt").write_text(f"topics: x.txt\nmap all {value}\nnum_rel all 10\nnum_rel_ret all 5\n")
    metrics = report.wide(report.latest(report.read_artifacts(spark, str(tmp_path / "r"))))
    issues = spark.createDataFrame([("new", ["we Accept it"])], "branch string, texts array<string>")
    rows = {r["branch"]: r for r in report.branch_report(metrics, issues).collect()}
    assert rows["new"]["place"] == 2 and round(rows["new"]["map_delta_vs_previous"], 9) == 0.05 and rows["new"]["decision"] == "accepted" and rows["original"]["decision"] == "unknown"
    assert "| new |" in report.markdown(metrics.orderBy("branch"), ["branch", "map"])
    assert report.spliced("<!-- m:start -->x<!-- m:end -->", "T", "m") == "<!-- m:start -->\nT\n<!-- m:end -->"


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("7 quick\n8 missing\n")
    docs = spark.createDataFrame([(0, "a", "quick fox"), (1, "b", "slow fox")], "doc_ord long, doc_no string, text string")
    from quillrank.operators.index import index_plain

    lines = spark.readStream.text(str(tmp_path / "in"))
    answer_stream(lines, index_plain(docs), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["topic_id"], r["doc_ord"], r["rank"]) for r in got] == [("7", 0, 1)]
    assert sparse.query_terms(spark.createDataFrame([("1", ["a", "a"])], "topic_id string, words array<string>")).first()["weight"] == 2


def test_artifacts_are_reused(spark, tmp_path):
    from quillrank.sources.artifacts import reused

    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for config in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert reused(spark, str(tmp_path), "t", config, make).count() == 3
    assert len(calls) == 2


def test_large_files_are_split_between_records(spark, tmp_path):
    rng = range(400)
    (tmp_path / "c").mkdir()
    for name in ("a", "b"):
        (tmp_path / "c" / f"{name}.xml").write_text("before" * (name == "b") + "".join(f"<DOC>\n<DOCNO> {name}-{i} </DOCNO>\nword{i} {'x' * (i % 90)}\n</DOC>\n" for i in rng))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        docs = read_collection(spark, str(tmp_path / "c"))
        assert docs.rdd.getNumPartitions() > 3
        got = sorted((r["doc_ord"], r["doc_no"]) for r in docs.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(f"{name}-{i}" for name in ("a", "b") for i in rng))


def test_reranking_requests(spark):
    run = spark.createDataFrame([("1", f"d{i}", i, 9.0 - i) for i in range(1, 5)] + [("2", "d1", 1, 1.0)], "topic_id string, doc_no string, rank int, score double")
    topics = spark.createDataFrame([("1", "red fox")], "topic_id string, text string")
    texts = spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(1, 4)], "doc_no string, doc_text string")
    asked = {(r["topic_id"], r["doc_no"]): r["prompt"] for r in neural.scoring_requests(run, topics, texts, "m", 4).collect()}
    assert asked["1", "d2"].endswith("Query: red fox\nPassage: text 2") and asked["1", "d4"].endswith("Passage: ") and "Query: 2\n" in asked["2", "d1"]
    cache = spark.createDataFrame([], "key string, response string")

    def model(prompts):
        return [json.dumps({"output_text": json.dumps({"winner": "B"} if "\nA: " in p else {"score": int((p[-1:].strip() or "0")) * 10})}) for p in prompts]

    first = neural.rerank(run, topics, texts, cache, model, Models(mono_docs=3, duo_docs=2, mode="mono"))
    assert [r["doc_no"] for r in first.where("topic_id = '1'").orderBy("rank").collect()] == ["d3", "d2", "d1", "d4"]
    both = neural.rerank(run, topics, texts, cache, model, Models(mono_docs=3, duo_docs=2, mode="mono_duo"))
    assert [r["doc_no"] for r in both.where("topic_id = '1'").orderBy("rank").collect()] == ["d2", "d3", "d1", "d4"]
    assert neural.rerank(run, topics, texts, cache, None, Models(mode="off")) is run
    new = neural.rewritten(topics, cache, lambda prompts: ['{"output_text": "fox red hunting wild"}'] * len(prompts))
    assert [(r["topic_id"], r["text"]) for r in new.collect()] == [("1", "fox red hunting")]


def test_retries_and_order():
    waits, calls = [], []

    def model(texts):
        calls.append(1)
        if len(calls) < 4:
            raise neural.Retryable(400, "We could not parse the JSON body") if len(calls) == 2 else neural.Retryable(503)
        return texts

    assert neural.patient(model, sleep=waits.append)(["a"]) == ["a"] and waits == [1.0, 2.0, 4.0]
    with pytest.raises(neural.Retryable):
        neural.patient(lambda t: (_ for _ in ()).throw(neural.Retryable(401)), sleep=waits.append)(["a"])
    assert neural.in_input_order([(1, "b"), (0, "a")], 2) == ["a", "b"]
    with pytest.raises(ValueError):
        neural.in_input_order([(0, "a")], 2)


def test_vectors_are_checked(spark):
    docs = spark.createDataFrame([(0,), (1,)], "doc_ord long")
    good = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "doc_ord long, embedding array<float>")
    assert neural.checked_vectors(good, docs, 2).count() == 2
    for bad, size in ((good.where("doc_ord = 0"), 2), (good, 3), (good.union(good.withColumn("doc_ord", F.lit(9).cast("long"))), 2)):
        with pytest.raises(ValueError):
            neural.checked_vectors(bad, docs, size)
    assert neural.usage(spark.createDataFrame([("a b", "c", False)], "prompt string, response string, hit boolean"), "gpt-5.1", "gpt-5-mini").first()["cost"] == 0


def test_sweep_saves_its_best_runs(spark, tmp_path):
    run = lambda names: spark.createDataFrame([("1", d, i + 1, 1.0 / (i + 1)) for i, d in enumerate(names)], "topic_id string, doc_no string, rank int, score double")
    runs = [run("abcd"), run("cabe"), run("dcxa")]
    qrels = spark.createDataFrame([("1", "c", 1), ("1", "e", 0), ("1", "x", 1)], "topic_id string, doc_no string, rel int")
    whole, measured = tuning.fused_sweep(runs, qrels, tuning.simplex(spark, 0.25, 0.25, 0.75), depth=2)
    kept = tuning.best_runs(whole, measured, 1).collect()
    assert sorted(r["doc_no"] for r in kept) == list("abcdex") and len({(r["w1"], r["w2"]) for r in kept}) == 1
    assert [r["rank"] for r in sorted(kept, key=lambda r: -r["score"])] == [1, 2, 3, 4, 5, 6]
    write_tsv(tuning.ranked_cells(measured).select("w1", "map"), str(tmp_path / "t"))
    lines = next((tmp_path / "t").glob("part-*")).read_text().splitlines()
    assert lines[0] == "w1\tmap" and len(lines) == 4
    write_metadata(spark, str(tmp_path / "m"), {"k": 60, "sources": "a b"})
    assert next((tmp_path / "m").glob("part-*")).read_text() == "k: 60\nsources: a b\n"


def test_dashboard(spark, tmp_path):
    for root, branch, value in (("r", "original", "0.2"), ("r", "new", "0.25"), ("s", "other", "0.1")):
        (tmp_path / root / branch).mkdir(parents=True, exist_ok=True)
        (tmp_path / root / branch / "eval-20260101-000000.txt").write_text(f"map all {value}\nnum_rel all 10\nnum_rel_ret all 5\n")
    text = report.dashboard(spark, [str(tmp_path / "r"), str(tmp_path / "s")], "x <!-- metrics:start --><!-- metrics:end --> y")
    assert "best of 3 branches: new, map 0.2500 (+25.00 % against the original)" in text and "| other | 0.1000 |" in text
    long = report.compare_to_baseline(report.wide(report.under_roots(spark, str(tmp_path / "r")), ("map",)), "original")
    assert [(r["branch"], round(r["delta"], 9)) for r in long.collect()] == [("new", 0.05)]
    assert report.history(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")).columns == ["a", "b"]
