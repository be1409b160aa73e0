"""Continuous index: documents that arrive are added to a written index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tagloom.functions.text import words
from tagloom.operators import index
from tagloom.operators.corpus import token_counts


def follow(docs: DataFrame, path: str, checkpoint: str, tokenize=words, once: bool = True) -> StreamingQuery:
    """Add a stream of documents (doc_id, text) to the index at ``path``.

    Each batch of the stream is a batch of the index, so one that is run again after a failure replaces what it left.
    """

    def add(batch: DataFrame, number: int) -> None:
        index.append(batch.sparkSession, path, token_counts(batch, tokenize=tokenize), f"stream{number}")

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
