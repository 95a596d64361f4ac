"""Sinks that hold every row once, also when a batch is run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_batches(
    stream: DataFrame, out: str, checkpoint: str, each: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Process what is there through ``each`` and stop.  A repeated batch overwrites its
    own folder, so the result holds every row once even when a batch is run again."""

    def save(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(stream.writeStream.foreachBatch(save), checkpoint)


def append_files(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop, through Spark's exactly-once file sink."""
    writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    return _start(writer, checkpoint)


def _start(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
