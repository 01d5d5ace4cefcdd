"""All stages over the smallest tables, each judged on its own input."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from quillrank.llm.near_dedup import near_duplicates
    from quillrank.llm.storage import stored

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, DATA), name)
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = seen["quality"][1].join(labels, "doc_id")
    assert kept.where("quality = 1").count() >= 0.9 * labels.where("quality = 1").count()
    deduped = seen["near_dedup"][1]
    assert near_duplicates(deduped).where("not kept").count() == 0
    mixed = seen["mixing"][1].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mixed <= 2
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1 and docs.count() == seen["mixing"][1].count()
