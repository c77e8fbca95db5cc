"""Request counters over a stream: the batch operator in complete mode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.operations import request_metrics


def count_requests(log: DataFrame, name: str, checkpoint: str):
    """A streaming query that keeps the counters of the whole log in a memory table."""
    return request_metrics(log).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
