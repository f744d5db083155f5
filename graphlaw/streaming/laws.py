"""Laws over streams of rows: each micro-batch is checked as a graph of its own.

Only laws about single nodes (values, and relations within a batch) make sense
there; what needs the whole graph, recursion above all, stays a batch query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphlaw.operators.check import check
from graphlaw.plans.registry import Registry
from graphlaw.sources.store import GraphStore


def check_stream(rows: DataFrame, to_store: Callable[[DataFrame], GraphStore], registry: Registry, only: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Offences of each micro-batch, appended as Parquet under path. A batch that is run again replaces its own output."""

    def one(batch: DataFrame, number: int) -> None:
        check(to_store(batch), registry, only).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
