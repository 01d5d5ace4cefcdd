"""Answering topics as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Ranking
from ..functions.text import topic_id, topic_words
from ..operators.index import Index
from ..operators.sparse import release, search


def answer_stream(lines: DataFrame, index: Index, out: str, checkpoint: str, ranking: Ranking = Ranking()) -> StreamingQuery:
    """Search every micro-batch of topic lines (``value``) and append its run to ``out``.

    Each batch is one plan over the index. A batch's rows go to a folder of its
    own number, so a repeated batch replaces its earlier attempt.
    """
    from pyspark.sql import functions as F

    parsed = lines.select(topic_id(F.col("value"), F.lit("0")).alias("topic_id"), topic_words(F.col("value")).alias("words"))

    def answer(batch: DataFrame, number: int) -> None:
        search(index, batch, ranking).write.mode("overwrite").parquet(f"{out}/batch={number}")
        release()

    return parsed.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
