"""Times the headline queries; prints one JSON line.

The index is built and saved once (``index_build``), then searches run on the
saved tables, each after one warm-up, as the published baseline was measured.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quillrank.config import SOURCES, Ranking  # noqa: E402
from quillrank.operators import evaluate, sparse  # noqa: E402
from quillrank.operators.dense import nearest  # noqa: E402
from quillrank.operators.fusion import fuse_with_tail  # noqa: E402
from quillrank.operators.index import index_plain, load_index  # noqa: E402
from quillrank.plans import catalog  # noqa: E402
from quillrank.sources.runs import printed  # noqa: E402


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp()
    times: dict[str, float] = {}

    def timed(name, run, warm=True):
        if warm:
            run()
        spark.catalog.clearCache()  # nothing computed by the warm-up is used again
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    def saved(name, df):
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("doc_no"), "text")
    index_plain(docs.limit(10)).forward.count()  # starts the session's code paths
    timed("index_build", lambda: index_plain(docs).save(f"{work}/index"), warm=False)
    index = load_index(spark, f"{work}/index")
    topics = saved("topics", catalog.topics_of(spark, data))
    terms = sparse.query_terms(topics)
    timed("bm25_top1000", lambda: sink(sparse.top(sparse.rank_bm25(index, terms), 1000)))
    timed("rm3_run", lambda: sink(sparse.top(sparse.rank_feedback(index, topics), 1000)))
    timed("sparse_default", lambda: sink(sparse.search(index, topics)))
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc_ord"), "embedding")
    asked = vectors.where("doc_ord < 50").select(F.col("doc_ord").cast("string").alias("topic_id"), "embedding")
    timed("dense_topk", lambda: sink(nearest(vectors, asked, 1000)))
    named = {
        "bm25": sparse.rank_bm25(index, terms), "rm3": sparse.rank_feedback(index, topics), "rm3exp": sparse.rank_feedback(index, topics, Ranking(expansion_only=True)),
    }
    runs = {k: saved(k, sparse.top(v, 1000).select("topic_id", F.col("doc_ord").cast("string").alias("doc_no"), "score", "rank")) for k, v in named.items()}
    three = [s for s in SOURCES if s.label in runs]
    timed("fusion", lambda: sink(fuse_with_tail(runs, three)))
    qrels = saved("qrels", catalog.qrels_of(spark, data))
    timed("evaluation", lambda: sink(evaluate.overall(evaluate.per_topic(printed(runs["bm25"]), qrels))))
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
