"""Linkage of records that arrive in a stream against a static source 1.

Each micro-batch is retrieved against source 1 as a plain batch plan and appended to a table; the
batch number is part of the path, so a batch that runs again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import block, prepare
from ..operators.tfidf import Block, top_k


def arrivals(batch: DataFrame, s1: DataFrame, k: int = 10, name: str = "word") -> DataFrame:
    """(country, q_id, p_id, score, rank): the nearest source-1 records of each arriving record."""
    b = block(name)
    return top_k(prepare(batch), prepare(s1), Block(name, b.text, k, b.max_df))


def link_stream(stream: DataFrame, s1: DataFrame, target: str, checkpoint: str, k: int = 10) -> StreamingQuery:
    """Start the query; results of batch n are under target/batch=n."""

    def one(batch: DataFrame, number: int) -> None:
        arrivals(batch, s1, k).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
