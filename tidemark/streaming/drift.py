"""Script versions as they arrive, compared to the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming import sinks

KEY = ["db_id", "name"]


def drift(scripts: DataFrame, ledger: DataFrame) -> DataFrame:
    """State of each script version: applied, mismatched or pending."""
    rows = ledger.select(*KEY, F.col("checksum").alias("applied_checksum"))
    state = (
        F.when(F.col("applied_checksum").isNull(), "pending")
        .when(F.col("applied_checksum") == F.col("checksum"), "applied")
        .otherwise("mismatched")
    )
    return scripts.join(rows, KEY, "left").withColumn("state", state)


def monitor(
    scripts: DataFrame, read_ledger: Callable[[SparkSession], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Judge arriving script versions.  The ledger is read anew for every batch; a static
    join would keep the file listing of the moment the stream was defined."""
    return sinks.write_batches(
        scripts, out, checkpoint, lambda batch: drift(batch, read_ledger(batch.sparkSession))
    )
