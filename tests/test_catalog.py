"""Some catalogue queries against their SQL; the driver compares all of them."""

import duckdb
import pytest

from quillrank.plans import catalog

DATA = "/root/testdata/sf0.001"
NAMES = ("collection_stats", "topics_parse", "bm25_top1000", "rewrite_normalize", "llm_parse", "page_fields", "fusion_simplex", "branch_report")


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    names = sorted(want.columns)
    got = catalog.queries()[name](spark, DATA)
    assert sorted(got.columns) == names
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall()))


@pytest.mark.parametrize("name", ["dense_every_20th", "fusion_ablations_whole", "fusion_grid_measures", "passage_grid_measures"])
def test_whole_jobs(spark, name):
    """Queries over the whole query set or grid, against their SQL."""
    test_against_sql(spark, name)


def test_dense_asks_with_every_20th_row(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id % 20 = 0").count()
    got = catalog.queries()["dense_every_20th"](spark, "/root/testdata/sf0.1")
    assert rows > catalog.DENSE_BLOCK and got.select("topic_id").distinct().count() == rows
