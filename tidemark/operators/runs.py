"""Runs: where they stop, what their attempts mean, what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import attach

KEY = ["db_id", "name"]


def run_replay(plan: DataFrame) -> DataFrame:
    """State of each pending script after a run that stops at its first failure.

    ``plan`` has db_id, name, ok; other columns ride along.  The place of the first failure is a plain minimum
    per database, so no window over a whole history is needed.
    """
    first = plan.where(~F.col("ok")).groupBy("db_id").agg(F.min("name").alias("failed_name"))
    stop = F.col("failed_name")
    state = (
        F.when(stop.isNull() | (F.col("name") < stop), "applied")
        .when(F.col("name") == stop, "failed")
        .otherwise("not_attempted")
    )
    return attach(plan, first, ["db_id"]).withColumn("state", state)


def first_successes(attempts: DataFrame) -> DataFrame:
    """The ledger row each key got: db_id, name, first_ok_at, first_checksum."""
    first = F.min(F.struct("ended_at", "checksum")).alias("_s")
    return (
        attempts.where(F.col("ok"))
        .groupBy(*KEY)
        .agg(first)
        .select(*KEY, F.col("_s.ended_at").alias("first_ok_at"), F.col("_s.checksum").alias("first_checksum"))
    )


def attempt_outcome(attempts: DataFrame) -> DataFrame:
    """What each attempt means: applied, skipped, mismatch, failed or unavailable.

    A failed attempt is read against the ledger as it stood when the attempt ended:
    another replica may have applied the same script meanwhile.  A transport failure
    says nothing about the script and is never read that way.
    """
    there = F.col("first_ok_at") <= F.col("ended_at")
    outcome = (
        F.when(F.col("ok"), "applied")
        .when(F.col("kind") == "unavailable", "unavailable")
        .when(there & (F.col("first_checksum") == F.col("checksum")), "skipped")
        .when(there, "mismatch")
        .otherwise("failed")
    )
    judged = attach(attempts, first_successes(attempts), KEY)
    return judged.withColumn("outcome", outcome)


def run_summary(outcomes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per database and replica: applied, skipped and duration.

    ``skipped`` starts at all ledger rows of the database, missing scripts included.
    """
    tracked = ledger.groupBy("db_id").agg(F.count("*").alias("tracked"))
    micros = F.timestamp_diff("MICROSECOND", F.min("attempted_at"), F.max("ended_at"))
    runs = outcomes.groupBy("db_id", "replica").agg(
        F.count_if(F.col("outcome") == "applied").alias("applied"),
        F.count_if(F.col("outcome") == "skipped").alias("_joined"),
        F.floor(micros / 1000).alias("duration_ms"),
    )
    return attach(runs, tracked, ["db_id"]).select(
        "db_id",
        "replica",
        "applied",
        (F.coalesce("tracked", F.lit(0)) + F.col("_joined")).alias("skipped"),
        "duration_ms",
    )


def double_applied(attempts: DataFrame) -> DataFrame:
    """Keys applied more than once, which a sound ledger rules out."""
    return (
        attempts.groupBy(*KEY)
        .agg(F.count_if("ok").alias("times_applied"))
        .where(F.col("times_applied") > 1)
    )
