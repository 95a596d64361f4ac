"""Attempts as they arrive: first successes and failures per hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(attempts: DataFrame, delay: str) -> DataFrame:
    """Watermarks need an instant; zone-free times are read in the session zone, UTC."""
    at = F.col("attempted_at").cast("timestamp")
    return attempts.withColumn("attempted_at", at).withWatermark("attempted_at", delay)


def applied_once(attempts: DataFrame, delay: str) -> DataFrame:
    """Each key once, at its first success within ``delay`` of event time.

    Which row of a batch survives is not fixed, so only the key is kept.
    """
    return _timed(attempts.where(F.col("ok")), delay).dropDuplicatesWithinWatermark(["db_id", "name"]).select("db_id", "name")


def failures_by_hour(attempts: DataFrame, delay: str) -> DataFrame:
    """Failed attempts per database, code and hour, emitted once the hour is closed."""
    hour = F.window("attempted_at", "1 hour")
    return (
        _timed(attempts.where(~F.col("ok")), delay)
        .groupBy(hour.alias("hour"), "db_id", "code")
        .agg(F.count("*").alias("failures"))
        .select(
            "db_id", "code", F.col("hour.start").alias("hour_start"), "failures"
        )
    )
