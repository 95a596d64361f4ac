"""Scripts against ledgers: status, gate, plan, baseline, check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import Moment, is_future_dated, is_valid
from tidemark.operators.keyed import attach, placed
from tidemark.session import pin

KEY = ["db_id", "name"]
# What to do about a future-dated script, by whether it was applied.
HINT_APPLIED = "already recorded; nothing to do until its date has passed"
HINT_PENDING = "not recorded yet; give it a name dated today or earlier"


def ledger_status(scripts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every script and ledger row with its state.

    applied (same checksum), mismatched (another checksum), pending (no ledger row) or
    missing (no script).
    """
    files = scripts.select(*KEY, F.col("checksum").alias("file_checksum"))
    rows = ledger.select(*KEY, F.col("checksum").alias("applied_checksum"), "applied_at")
    state = (
        F.when(F.col("applied_checksum").isNull(), "pending")
        .when(F.col("file_checksum").isNull(), "missing")
        .when(F.col("file_checksum") == F.col("applied_checksum"), "applied")
        .otherwise("mismatched")
    )
    return files.join(rows, KEY, "full_outer").select(
        *KEY, state.alias("state"), "file_checksum", "applied_checksum", "applied_at"
    )


def future_dated(scripts: DataFrame, ledger: DataFrame, now: Moment) -> DataFrame:
    """Scripts dated ahead of ``now``, whether they were applied, and what to do."""
    ahead = scripts.where(is_future_dated(F.col("name"), now)).select(*KEY)
    known = ledger.select(*KEY, F.lit(True).alias("_known"))
    applied = F.coalesce("_known", F.lit(False))
    return ahead.join(known, KEY, "left").select(
        *KEY,
        applied.alias("applied"),
        F.when(applied, HINT_APPLIED).otherwise(HINT_PENDING).alias("hint"),
    )


def checksum_gate(scripts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Applied scripts whose content changed; any of them blocks its database."""
    files = scripts.select(*KEY, F.col("checksum").alias("file_checksum"))
    rows = ledger.select(*KEY, F.col("checksum").alias("applied_checksum"))
    return files.join(rows, KEY).where(F.col("file_checksum") != F.col("applied_checksum"))


def blocked(gate: DataFrame) -> DataFrame:
    """Per blocked database, the first drifted script in apply order."""
    first = F.min(F.struct("name", "applied_checksum", "file_checksum")).alias("_f")
    return gate.groupBy("db_id").agg(first).select("db_id", "_f.*")


def pending(scripts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Scripts without a ledger row."""
    return scripts.join(ledger.select(*KEY), KEY, "left_anti")


def pending_plan(scripts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pending scripts with their 0-based place in the apply order of their database."""
    return placed(pending(scripts, ledger).select(*KEY, "checksum"), ["db_id"], ["name"])


def ledger_check(scripts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows that no longer hold: missing or mismatched."""
    files = scripts.select(*KEY, F.col("checksum").alias("file_checksum"))
    rows = ledger.select(*KEY, F.col("checksum").alias("applied_checksum"), "applied_at")
    gone = F.col("file_checksum").isNull()
    return (
        rows.join(files, KEY, "left")
        .where(gone | (F.col("file_checksum") != F.col("applied_checksum")))
        .withColumn("state", F.when(gone, "missing").otherwise("mismatched"))
    )


def baseline_targets(scripts: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, unknown): requested scripts once each, and requested names not found."""
    wanted = requested.select(*KEY).dropDuplicates()
    targets = scripts.join(wanted, KEY, "left_semi")
    unknown = wanted.join(scripts.select(*KEY), KEY, "left_anti")
    return targets, unknown


def baseline_plan(targets: DataFrame, ledger: DataFrame) -> DataFrame:
    """What recording ``targets`` as applied would do.

    insert, skip (same checksum), mismatch, or void: an insert of a database in which
    some target mismatches, so that nothing of it is recorded.
    """
    rows = ledger.select(*KEY, F.col("checksum").alias("applied_checksum"))
    action = (
        F.when(F.col("applied_checksum").isNull(), "insert")
        .when(F.col("applied_checksum") == F.col("checksum"), "skip")
        .otherwise("mismatch")
    )
    joined = targets.select(*KEY, "checksum").join(rows, KEY, "left")
    judged = pin(joined.withColumn("action", action))  # used twice, and hashed from contents
    stopped = judged.where(F.col("action") == "mismatch").groupBy("db_id").agg(
        F.min("name").alias("stopped_by")
    )
    voided = F.col("stopped_by").isNotNull() & (F.col("action") == "insert")
    return attach(judged, stopped, ["db_id"]).withColumn(
        "action", F.when(voided, "void").otherwise(F.col("action"))
    )


def baseline_outcome(
    inserts: DataFrame, ledger_after: DataFrame, failures: DataFrame | None = None
) -> DataFrame:
    """After a failed baseline, per database: skipped, mismatch, failed or unavailable.

    The ledger read after the failure decides: all rows there with the same checksum
    means another writer recorded them; else the first row that differs speaks.
    ``failures`` has db_id and kind; a transport failure (``unavailable``) says nothing
    about the rows and is never read that way.
    """
    rows = ledger_after.select(*KEY, F.col("checksum").alias("_now"))
    finding = F.when(F.col("_now").isNull(), "failed").when(
        F.col("_now") != F.col("checksum"), "mismatch"
    )
    judged = inserts.select(*KEY, "checksum").join(rows, KEY, "left").withColumn("_f", finding)
    first = F.min(F.when(F.col("_f").isNotNull(), F.struct("name", "_f")))
    found = judged.groupBy("db_id").agg(F.count("*").alias("n_rows"), first.alias("_x")).select(
        "db_id",
        "n_rows",
        F.coalesce("_x._f", F.lit("skipped")).alias("outcome"),
        F.col("_x.name").alias("first_name"),
    )
    if failures is None:
        return found
    down = failures.where(F.col("kind") == "unavailable").select("db_id").distinct()
    lost = F.coalesce("_down", F.lit(False))
    return found.join(down.withColumn("_down", F.lit(True)), "db_id", "left").select(
        "db_id",
        "n_rows",
        F.when(lost, "unavailable").otherwise(F.col("outcome")).alias("outcome"),
        F.when(~lost, F.col("first_name")).alias("first_name"),
    )


def check_rollup(
    databases: DataFrame, scanned: DataFrame, ledger: DataFrame, read: DataFrame, now: Moment
) -> DataFrame:
    """One row per database: would a run succeed?

    ``scanned`` carries split verdicts.  ``read`` lists the databases whose ledger could
    be read; for the others every script counts as pending and drift stays unknown.
    Future-dated and missing scripts are warnings.
    """
    readable = read.select("db_id").withColumn("_read", F.lit(True))
    well = is_valid(F.col("name"))
    good, bad = scanned.where(well), scanned.where(~well)
    files = good.select(
        *KEY,
        F.col("checksum").alias("file_checksum"),
        F.col("ok").alias("_ok"),
        is_future_dated(F.col("name"), now).alias("_future"),
    )
    rows = ledger.select(*KEY, F.col("checksum").alias("applied_checksum"))
    facts = files.join(rows, KEY, "full_outer").select(
        "db_id",
        F.col("applied_checksum").isNull().alias("_pending"),
        "_ok",
        "_future",
        F.col("file_checksum").isNull().alias("_missing"),
        (F.col("file_checksum") != F.col("applied_checksum")).alias("_drift"),
        (F.col("file_checksum").isNotNull() & F.col("applied_checksum").isNotNull()).alias("_tracked"),
        F.lit(False).alias("_ill"),
    )
    none = F.lit(None).cast("boolean")
    ill = bad.select(
        "db_id",
        F.lit(False).alias("_pending"),
        none.alias("_ok"),
        none.alias("_future"),
        F.lit(False).alias("_missing"),
        none.alias("_drift"),
        F.lit(False).alias("_tracked"),
        F.lit(True).alias("_ill"),
    )
    counts = facts.unionByName(ill).groupBy("db_id").agg(
        F.count_if("_ill").alias("invalid_names"),
        F.count_if("_pending").alias("pending"),
        F.count_if(F.col("_pending") & ~F.col("_ok")).alias("pending_bad"),
        F.count_if(F.col("_tracked") & ~F.col("_ok")).alias("_tracked_bad"),
        F.count_if("_tracked").alias("_tracked"),
        F.count_if("_drift").alias("mismatched"),
        F.count_if("_missing").alias("missing"),
        F.count_if("_future").alias("future_dated"),
    )
    seen = F.coalesce("_read", F.lit(False))

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    pending_n = count("pending") + F.when(seen, 0).otherwise(count("_tracked"))
    bad_n = count("pending_bad") + F.when(seen, 0).otherwise(count("_tracked_bad"))
    drift_n = F.when(seen, count("mismatched")).otherwise(0)
    return (
        databases.select("db_id")
        .join(counts, "db_id", "left")
        .join(readable, "db_id", "left")
        .select(
            "db_id",
            ((count("invalid_names") == 0) & (bad_n == 0) & (drift_n == 0)).alias("ok"),
            seen.alias("db_checked"),
            count("invalid_names").alias("invalid_names"),
            pending_n.alias("pending"),
            bad_n.alias("pending_bad"),
            drift_n.alias("mismatched"),
            F.when(seen, count("missing")).otherwise(0).alias("missing"),
            count("future_dated").alias("future_dated"),
        )
    )
