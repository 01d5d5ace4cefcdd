"""Eleven toy documents with values worked out by hand from the definitions."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillrank.config import Models, Ranking, Source, settings
from quillrank.operators import evaluate, fusion, sparse, tuning
from quillrank.operators.dense import nearest, nearest_native
from quillrank.operators.index import index_plain, load_index

COUNT = "ten nine eight seven six five four three two one".split()


@pytest.fixture(scope="module")
def index(spark):
    rows = [(0, "0", "zero")] + [(i, str(i), " ".join(COUNT[:i])) for i in range(1, 11)]
    return index_plain(spark.createDataFrame(rows, "doc_ord long, doc_no string, text string"))


def topics(spark, *texts):
    return spark.createDataFrame([(str(i), t.split()) for i, t in enumerate(texts)], "topic_id string, words array<string>")


def scores(df, topic="0", name="score"):
    return {r["doc_ord"]: round(r[name], 4) for r in df.where(F.col("topic_id") == topic).collect()}


def test_bm25(spark, index):
    got = sparse.rank_bm25(index, sparse.query_terms(topics(spark, "zero", "one", "ten")))
    assert scores(got) == {0: 2.6622}
    assert scores(got, "1") == {10: 2.1427}
    assert scores(got, "2") == {1: 0.1058, 2: 0.1030, 3: 0.1004, 4: 0.0979, 5: 0.0955, 6: 0.0933, 7: 0.0911, 8: 0.0890, 9: 0.0871, 10: 0.0852}


def test_feedback(spark, index):
    asked = topics(spark, "zero", "one", "ten")
    terms = sparse.query_terms(asked)
    more = sparse.expansion_terms(index, terms, sparse.rank_bm25(index, terms)).collect()
    assert {r["term"]: round(r["weight"], 6) for r in more if r["topic_id"] == "1"} == {"two": 0.130861, "three": 0.099737, "four": 0.077653, "five": 0.060524, "six": 0.046529, "seven": 0.034696}
    assert {r["term"]: round(r["weight"], 6) for r in more if r["topic_id"] == "2"} == {"nine": 0.142255, "eight": 0.135288, "seven": 0.108608, "six": 0.063849}
    assert all(abs(sum(r["weight"] for r in more if r["topic_id"] == t) - 0.45) < 1e-9 for t in "12")
    rm3 = sparse.rank_feedback(index, asked)
    assert scores(rm3, "1") == {10: 2.6098, 9: 0.4775, 8: 0.2800, 7: 0.1626, 6: 0.0896, 5: 0.0440, 4: 0.0161}
    only = sparse.rank_feedback(index, asked, Ranking(expansion_only=True))
    assert scores(only) == {0: 2.6622}
    assert scores(only, "1") == {9: 0.4775, 10: 0.4672, 8: 0.2800, 7: 0.1626, 6: 0.0896, 5: 0.0440, 4: 0.0161}


def test_passages_and_saved_index(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    saved = load_index(spark, str(tmp_path / "i"))
    asked = topics(spark, "ten nine", "nine one two")
    got = sparse.search(saved, asked)
    assert scores(got) == {6: 0.5718, 7: 0.5601, 8: 0.5489, 9: 0.5382, 5: 0.5354, 10: 0.5280, 4: 0.4813, 3: 0.4279, 2: 0.3863, 1: 0.1058}
    assert scores(got, "1") == {10: 5.1202, 9: 2.5093, 8: 0.5585, 7: 0.4130, 6: 0.3245, 5: 0.2712, 4: 0.2410, 3: 0.2241, 2: 0.2169}
    assert sorted(r["rank"] for r in got.where("topic_id = '0'").collect()) == list(range(1, 11))


def test_duplicates_and_ubiquity(spark, index):
    got = sparse.rank_bm25(index, sparse.query_terms(topics(spark, "one one")))
    assert scores(got) == {10: 4.2853}
    everywhere = index_plain(spark.createDataFrame([(0, "a", "x y"), (1, "b", "x")], "doc_ord long, doc_no string, text string"))
    assert sparse.rank_bm25(everywhere, sparse.query_terms(topics(spark, "x"))).count() == 0


def test_gate(spark, index):
    asked = topics(spark, "one one one one one one one")
    assert scores(sparse.rank_feedback(index, asked)) == scores(sparse.rank_bm25(index, sparse.query_terms(asked)))


def test_fusion(spark):
    a = spark.createDataFrame([("1", d, i + 1, 0.0) for i, d in enumerate("abcd")], "topic_id string, doc_no string, rank int, score double")
    b = spark.createDataFrame([("1", d, i + 1, 0.0) for i, d in enumerate("cae")], "topic_id string, doc_no string, rank int, score double")
    got = fusion.fuse_with_tail({"A": a, "B": b}, [Source("A", 0.6, 2), Source("B", 0.4, 2)]).orderBy("rank").collect()
    assert [(r["doc_no"], round(r["score"], 9)) for r in got] == [("a", 0.016287678), ("b", 0.009677419), ("c", 0.006557377), ("d", 0.006557376), ("e", 0.006557375)]


def test_evaluation(spark):
    run = spark.createDataFrame([("1", "a", 3.0), ("1", "b", 2.0), ("1", "c", 1.0), ("1", "d", 0.5)], "topic_id string, doc_no string, score double")
    qrels = spark.createDataFrame([("1", "a", 1), ("1", "b", 0), ("1", "c", 1), ("1", "z", 1), ("2", "q", 1)], "topic_id string, doc_no string, rel int")
    rows = {r["topic_id"]: r for r in evaluate.per_topic(run, qrels).collect()}
    assert rows["1"]["map"] == pytest.approx((1 + 2 / 3) / 3) and rows["1"]["Rprec"] == pytest.approx(2 / 3) and rows["1"]["recip_rank"] == 1
    assert rows["1"]["bpref"] == pytest.approx((1 + 0) / 3) and rows["1"]["P_5"] == pytest.approx(0.4) and rows["2"]["map"] == 0
    assert rows["1"]["iprec_at_recall_0.50"] == pytest.approx(2 / 3) and rows["1"]["iprec_at_recall_1.00"] == 0
    assert evaluate.overall(evaluate.per_topic(run, qrels)).first()["num_q"] == 2


def test_dense_forms_agree(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)], "doc_ord long, embedding array<float>")
    asked = vectors.where("doc_ord < 3").select(F.col("doc_ord").cast("string").alias("topic_id"), "embedding")
    key = lambda r: (r["topic_id"], r["rank"], r["doc_ord"], round(r["score"], 6))
    assert sorted(map(key, nearest(vectors, asked, 5, block=2).collect())) == sorted(map(key, nearest_native(vectors, asked, 5).collect()))


def test_dense_sends_no_vectors_to_the_driver(spark):
    """Query sets of many blocks: exact, with ties, none collected, and one scan of the vectors however many blocks."""
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(3000)], "doc_ord long, embedding array<float>")
    asked = vectors.where("doc_ord < 90").select(F.col("doc_ord").cast("string").alias("topic_id"), "embedding")
    made = nearest(vectors, asked, 20, block=8)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 3
    key = lambda r: (r["topic_id"], r["rank"], r["doc_ord"], round(r["score"], 6))
    got = sorted(map(key, made.collect()))
    assert len(got) == 1800 and got == sorted(map(key, nearest_native(vectors, asked, 20).collect()))
    assert nearest(vectors, asked.limit(0), 20).count() == 0 and nearest(vectors.limit(0), asked, 20).count() == 0


def test_grids(spark, index):
    assert tuning.simplex(spark).count() == 171
    with pytest.raises(ValueError):
        tuning.simplex(spark, 0.3)
    terms = sparse.query_terms(topics(spark, "ten nine"))
    cell = tuning.bm25_grid(index, terms, tuning.grid(spark, k1=(0.7, 1.2), b=(0.3, 0.75))).where("k1 = 1.2 and b = 0.75")
    assert scores(cell) == scores(sparse.rank_bm25(index, terms, replace(Ranking(), k1=1.2, b=0.75)))


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("A=1\nB='two'\n# no\n")
    (tmp_path / ".env.local").write_text("A=9\nC=3\n")
    monkeypatch.setenv("B", "env")
    assert settings(str(tmp_path / ".env"), str(tmp_path / ".env.local")) == {"A": "1", "B": "env", "C": "3"}
    with pytest.raises(ValueError):
        Ranking(k1=-1)
    with pytest.raises(ValueError):
        Models(duo_docs=100)


def test_hybrid_pipeline(spark, index):
    """The richest fusion of what is given, by hand from its sources' runs."""
    from quillrank.config import SOURCES
    from quillrank.plans.pipeline import hybrid, source_runs

    asked = topics(spark, "ten nine", "one")
    runs = source_runs(index, asked)
    want = fusion.fuse_with_tail(runs, [s for s in SOURCES if s.label in runs])
    rows = lambda df: sorted((r["topic_id"], r["rank"], r["doc_no"], round(r["score"], 10)) for r in df.collect())
    assert set(runs) == {"bm25", "rm3", "rm3exp"} and rows(hybrid(index, asked)) == rows(want)
    vectors = spark.createDataFrame([(i, [float(i == 3), float(i != 3)]) for i in range(11)], "doc_ord long, embedding array<float>")
    queries = spark.createDataFrame([("0", [1.0, 0.0]), ("1", [0.0, 1.0])], "topic_id string, embedding array<float>")
    again = spark.createDataFrame([("1", ["one", "two"])], "topic_id string, words array<string>")
    whole = hybrid(index, asked, rewritten=again, vectors=vectors, asked=queries, rerank=lambda run: run.where("rank <= 3"))
    got = {(r["topic_id"], r["rank"]): r["doc_no"] for r in whole.collect()}
    assert got["1", 1] == "10" and len(got) == 6
    made = fusion.ablations(source_runs(index, asked, rewritten=again, vectors=vectors, asked=queries), list(SOURCES))
    assert set(made) == {*fusion.ABLATIONS, "bm25"} and fusion.richest(made) == "all"
