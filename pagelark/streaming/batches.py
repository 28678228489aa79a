"""Micro-batches of new pages through a batch plan.

The engine has no streaming semantics of its own. Its operators run no action, so a stream of new documents can be handed
to them batch by batch; each batch is written under its number, and a batch that is retried overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def per_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that applies plan to each micro-batch and writes its rows to path/batch=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
