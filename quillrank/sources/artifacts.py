"""Tables that are reused while their configuration stays the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def config_key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def _complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def reused(spark: SparkSession, root: str, name: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of this ``config`` below ``root``; made if it isn't there whole.

    A written table carries a success mark; one without it is written anew.
    The configuration is kept beside it, one JSON line.
    """
    path = f"{root}/{name}-{config_key(config)}"
    if not _complete(spark, path):
        make().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.config")
    return spark.read.parquet(path)
