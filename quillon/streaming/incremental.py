"""Postings kept up to date from a stream of documents (an addition; a batch build needs none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import postings


def follow(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the postings of new documents to the Parquet index at path, a folder for each batch, so a repeated batch overwrites itself."""

    def add(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
