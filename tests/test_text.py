import random
import re

import pytest
from pyspark.sql import functions as F

from quillrank.functions.text import normalise, raw_tokens, topic_id, topic_words

STEMS = {
    "Cities": "city", "ties": "tie", "Glasses": "glass", "sses": "sse", "boxes": "box", "axes": "axe", "Churches": "church", "dishes": "dish", "quizzes": "quizz", "bus": "bus",
    "gas": "gas", "News": "news", "class": "class", "analysis": "analysis", "prices": "price", "its": "its", "cats": "cat", "x" * 300: "x" * 255,
}


def test_normaliser(spark):
    rows = spark.createDataFrame([(k,) for k in STEMS], "t string").select("t", normalise(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == STEMS


def lexed(text):
    """A token at a time: a tag up to > or the line's end, or a word with inner hyphens."""
    out, i = [], 0
    alnum = lambda c: c.isascii() and c.isalnum()
    while i < len(text):
        j = i + 1
        if text[i] == "<":
            while j < len(text) and text[j - 1] != ">" and text[j] != "\n":
                j += 1
            out.append(text[i:j])
        elif alnum(text[i]):
            while j < len(text) and (alnum(text[j]) or text[j] == "-"):
                j += 1
            out.append(text[i:j])
        i = j
    return out


def test_lexer_fuzz(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB3-<> \né&") for _ in range(rng.randrange(30))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", raw_tokens(F.col("t")).alias("k")).collect()
    assert all(r["k"] == lexed(texts[r["i"]]) for r in rows)


@pytest.mark.parametrize(("line", "want"), [("007 Foo bars", ("7", ["foo", "bar"])), ("+7 a", ("7", ["a"])), ("no id here", ("5", ["no", "id", "here"])), ("foo, b", ("5", ["foo,", "b"]))])
def test_topic_lines(spark, line, want):
    row = spark.createDataFrame([(line,)], "t string").select(topic_id(F.col("t"), F.lit(5)).alias("i"), topic_words(F.col("t")).alias("w")).first()
    assert (row["i"], row["w"]) == want


def test_lexed_model_matches_pattern():
    assert lexed("a<b>c") == re.findall(r"<[^>\n]*>?|[A-Za-z0-9][A-Za-z0-9-]*", "a<b>c")


def test_printed_as_sql_prints(spark):
    """Scores at four places as C and DuckDB round them: by the binary value, exact ties to even."""
    import random

    import duckdb

    from quillrank.sources.runs import printed

    random.seed(1)
    values = [0.00045, 0.00125, 0.00375, 0.01125, 0.03125, 0.09375, 0.15625, -0.00045, 0.0, 1e15 + 0.5, 123456.78905, 0.99995]
    values += [round(random.random(), 5) for _ in range(3000)] + [w / 20 / (60 + r) for w in range(1, 19) for r in range(1, 251)]
    got = [r[0] for r in printed(spark.createDataFrame([(v,) for v in values], "score double")).collect()]
    told = duckdb.connect().execute("SELECT list_transform(?, lambda x: CAST(format('{:.4f}', x) AS DOUBLE))", [values]).fetchall()[0][0]
    assert got == told == [float(f"{v:.4f}") for v in values]


def test_scans_agree_with_expressions(spark):
    """Terms, lengths, counts and postings by Python workers are those of the column expressions."""
    from collections import Counter

    from pyspark.sql import functions as F

    from quillrank.functions import scan
    from quillrank.functions.text import body_terms
    from quillrank.operators.index import index_plain

    texts = ["Cities ties Glasses sses boxes axes Churches dishes quizzes bus gas News class analysis its", "a-b <b class='x'>AT&T</b> unclosed <i tag\nnext> ñandú es", "", None, "x" * 300 + "s", "A a aS <>"]
    docs = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "doc_ord long, doc_no string, text string")
    want = {r[0]: r[1] for r in docs.select("doc_ord", body_terms(F.col("text"))).collect()}
    index = index_plain(docs)
    assert {r["doc_ord"]: r["terms"] for r in index.forward.collect()} == want
    assert {r["doc_ord"]: r["doc_len"] for r in index.lengths().collect()} == {k: len(v) for k, v in want.items()}
    for distinct in (False, True):
        assert {r["term"]: r["n"] for r in index.term_counts(distinct).collect()} == Counter(t for v in want.values() for t in (set(v) if distinct else v))
    counts = Counter((t, k) for k, v in want.items() for t in v)
    assert {(r["term"], r["doc_ord"]): (r["tf"], r["doc_len"]) for r in index.all_postings().collect()} == {k: (n, len(want[k[1]])) for k, n in counts.items()}
    assert index.totals() == (len(texts), sum(map(len, want.values())) / len(texts))
    assert scan.normalised("Boxes") == "box"


def test_no_table_of_terms_is_shuffled_or_kept(spark):
    """A ranking's plan scans texts: no explode of all terms, no cached term streams (both grew with the corpus)."""
    from quillrank.operators import sparse
    from quillrank.operators.index import index_plain

    docs = spark.createDataFrame([(i, str(i), f"one two {'three ' * (i % 3)}w{i}") for i in range(50)], "doc_ord long, doc_no string, text string")
    asked = spark.createDataFrame([("1", ["three", "two"])], "topic_id string, words array<string>")
    index = index_plain(docs)
    run = sparse.rank_feedback(index, asked, most=3)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "InMemory" not in plan
    whole = {(r["topic_id"], r["doc_ord"]): r["rank"] for r in sparse.top(sparse.rank_feedback(index, asked), 3).collect()}
    assert {(r["topic_id"], r["doc_ord"]): r["rank"] for r in sparse.top(run, 3).collect()} == whole and len(whole) == 3


def test_passages_are_found_wherever_they_lie(spark):
    """Texts that contain a passage, against a plain search: at every offset, short ones, and over texts' edges."""
    import pyarrow as pa

    from quillrank.functions import scan

    passages = [("a", "Ciónos dollga ñarie"), ("b", "12345678"), ("c", "kurz"), ("d", "Ciónos dollga other"), ("e", "ñ"), ("f", "12345678 and more")]
    texts = ["." * i + p for i in range(17) for _, p in passages] + ["1234", "5678", "", None, "x12345678", "Ciónos dollga ", "ñarie"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_no string, text string").coalesce(1)
    got = {tuple(r) for r in docs.mapInArrow(scan.holding(passages, pa.string()), "topic_id string, doc_no string").collect()}
    assert got == {(k, str(i)) for k, p in passages for i, t in enumerate(texts) if t is not None and p in t}


def test_poor_documents_are_counted_not_listed(spark):
    """Measures with ``poor`` equal those with every pair of a topic and a poor document listed, and each judgment counts once."""
    from pyspark.sql import functions as F

    from quillrank.operators import evaluate

    run = spark.createDataFrame([(str(t), str(d), float(97 * d * (t + 1) % 31)) for t in range(4) for d in range(40)], "topic_id string, doc_no string, score double")
    relevant = spark.createDataFrame([(str(t), str(d), 1) for t in range(3) for d in range(t, 60, 7)], "topic_id string, doc_no string, rel int")
    poor = spark.createDataFrame([(str(d),) for d in range(0, 60, 3)], "doc_no string")
    listed = poor.crossJoin(run.select("topic_id").distinct()).join(relevant, ["topic_id", "doc_no"], "left_anti").withColumn("rel", F.lit(0))
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(evaluate.per_topic(run, relevant.unionByName(listed)))
    assert len(want) == 3 and rows(evaluate.per_topic(run, relevant, poor=poor)) == want
    assert rows(evaluate.per_topic(run, relevant.union(relevant), poor=poor)) == want


def test_grid_crosses_no_cells_before_topics_meet(spark, monkeypatch):
    """Every cell of a BM25 grid ranks as a search with its settings; postings are not multiplied by cells in the plan."""
    from dataclasses import replace

    from quillrank.config import Ranking
    from quillrank.operators import sparse, tuning
    from quillrank.operators.index import index_plain

    monkeypatch.setattr(tuning, "RESULTS", 5)
    docs = spark.createDataFrame([(i, str(i), " ".join(["a"] * (i % 4) + ["b"] * (i % 3) + ["c"] * (i % 17))) for i in range(120)], "doc_ord long, doc_no string, text string")
    index = index_plain(docs)
    terms = sparse.query_terms(spark.createDataFrame([("1", ["a", "b"]), ("2", ["b", "c", "c"]), ("3", ["none"])], "topic_id string, words array<string>"))
    run = tuning.bm25_grid(index, terms, tuning.grid(spark, k1=(0.3, 0.7, 2.0), b=(0.1, 0.75)))
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = run.collect()
    for k1, b in ((0.3, 0.1), (0.7, 0.75), (2.0, 0.1)):
        want = sparse.top(sparse.rank_bm25(index, terms, replace(Ranking(), k1=k1, b=b)), 5).collect()
        key = lambda r: (r["topic_id"], r["rank"], r["doc_ord"], round(r["score"], 9))
        assert sorted(key(r) for r in rows if (r["k1"], r["b"]) == (k1, b)) == sorted(map(key, want)) and len(want) == 10
