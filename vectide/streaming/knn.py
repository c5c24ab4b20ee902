"""Streaming search: each micro-batch of query vectors against a standing base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vectide.operators.exact import knn_join


def search_stream(queries: DataFrame, base: DataFrame, k: int, sink: Callable[[DataFrame, int], None], metric: str = "l2", checkpoint: str | None = None):
    """Start a query that answers every micro-batch of streaming rows (id, vec).

    sink(results, epoch) gets (qid, rnk, id, dist) and must be idempotent per epoch.
    """
    writer = queries.writeStream.foreachBatch(lambda df, epoch: sink(knn_join(base, df, k, metric), epoch))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
