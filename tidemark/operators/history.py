"""Histories: rising names, requested names, another tool's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators.keyed import attach, rising
from tidemark.sources.journal import dialect_of


def seconds_of_millis(millis: Column) -> Column:
    """Whole seconds of epoch milliseconds, rounded down also below zero."""
    return F.floor(millis.cast("decimal(20,0)") / 1000).cast("bigint")


def monotonic_names(entries: DataFrame) -> DataFrame:
    """Target names of journal entries: their times in UTC, strictly rising by seconds.

    ``entries`` has db_id, idx, pos, when (milliseconds), tag; other columns ride along.
    ``reason`` is set where no valid name can be derived.
    """
    seconds = entries.withColumn("_sec", seconds_of_millis(F.col("when")))
    named = rising(seconds, ["db_id"], ["idx", "pos"], "_sec", F.lit(0), "second").drop("_sec")
    prefix = names.prefix_of(F.col("second"))
    target = F.concat(prefix, F.lit("_"), names.tag_slug(F.col("tag")), F.lit(".sql"))
    reason = F.when(F.col("target_name").isNull(), names.BAD_PREFIX).otherwise(
        names.invalid_reason(F.col("target_name"))
    )
    return named.withColumn("target_name", target).withColumn("reason", reason)


def latest_instants(scripts: DataFrame) -> DataFrame:
    """Per database, the latest readable time among valid names; null if there is none."""
    return scripts.groupBy("db_id").agg(F.max(names.instant(F.col("name"))).alias("latest"))


def allocate_names(requests: DataFrame, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, refused) for requests (db_id, seq, requested_at, slug).

    A name takes the request's second or the next one after the latest script and the
    previous request, whichever is later.  Past the last second that fourteen digits can
    write, a request is refused.
    """
    cleaned = requests.withColumn("_slug", names.requested_slug(F.col("slug")))
    refused = cleaned.where(F.col("_slug").isNull()).select(
        "db_id", "seq", "slug", F.lit(names.BAD_REQUEST).alias("reason")
    )
    seeded = attach(cleaned.where(F.col("_slug").isNotNull()), latest_instants(scripts), ["db_id"])
    timed = seeded.select(
        "db_id",
        "seq",
        "slug",
        "_slug",
        names.epoch_seconds(F.col("requested_at")).alias("_sec"),
        names.epoch_seconds(F.col("latest")).alias("_latest"),
    )
    floor = F.coalesce(F.col("_latest"), F.lit(names.FIRST_SECOND))
    given = rising(timed, ["db_id"], ["seq"], "_sec", floor, "second")
    name = F.concat(names.prefix_of(F.col("second")), F.lit("_"), F.col("_slug"), F.lit(".sql"))
    named = given.select("db_id", "seq", "slug", name.alias("name"))
    late = named.where(F.col("name").isNull()).select(
        "db_id", "seq", "slug", F.lit(names.BAD_PREFIX).alias("reason")
    )
    return named.where(F.col("name").isNotNull()).drop("slug"), refused.unionByName(late)


def adopt_match(items: DataFrame, foreign: DataFrame, mode: str = "auto") -> DataFrame:
    """Which imported scripts count as applied, and where their content drifted.

    ``items`` has db_id, tag, when, target_name, raw_hash.  In ``auto`` the other tool's
    ledger decides by equal times; ``all`` and ``none`` do not look at it.
    """
    if mode in ("all", "none"):
        state = "applied" if mode == "all" else "pending"
        return items.withColumn("state", F.lit(state)).withColumn(
            "recorded_hash", F.lit(None).cast("string")
        ).withColumn("drifted", F.lit(False))
    first = foreign.groupBy("db_id", F.col("created_at").alias("when")).agg(
        F.min("hash").alias("recorded_hash")
    )
    matched = F.col("recorded_hash").isNotNull()
    drifted = F.coalesce(F.col("recorded_hash") != F.col("raw_hash"), F.lit(False))
    return (
        attach(items, first, ["db_id", "when"])
        .withColumn("state", F.when(matched, "applied").otherwise("pending"))
        .withColumn("drifted", drifted)
    )


def adopt_source_check(
    journals: DataFrame, entries: DataFrame, dialects: DataFrame, files: DataFrame
) -> DataFrame:
    """Per journal the first reason it cannot be taken over, null if it can.

    ``journals`` has db_id, dialect; ``dialects`` db_id, dialect of the target;
    ``files`` db_id, tag.
    """
    counts = entries.groupBy("db_id").agg(F.count("*").alias("_n"))
    absent = entries.join(files.select("db_id", "tag"), ["db_id", "tag"], "left_anti")
    first = absent.groupBy("db_id").agg(F.min(F.struct("idx", "pos", "tag")).alias("_a"))
    target = dialects.select("db_id", F.col("dialect").alias("_target"))
    source = dialect_of(F.col("dialect"))
    reason = (
        F.when(source.isNull(), F.concat(F.lit("unsupported dialect "), F.col("dialect")))
        .when(F.col("_n").isNull(), "the journal has no entries")
        .when(
            ~source.eqNullSafe(F.col("_target")),
            F.concat(
                F.lit("journal dialect is "),
                source,
                F.lit(" but the target database is "),
                F.coalesce("_target", F.lit("not configured")),
            ),
        )
        .when(
            F.col("_a").isNotNull(),
            F.concat(F.lit("journal entry `"), F.col("_a.tag"), F.lit("` has no file")),
        )
    )
    return (
        journals.select("db_id", "dialect")
        .join(counts, "db_id", "left")
        .join(target, "db_id", "left")
        .join(first, "db_id", "left")
        .select("db_id", reason.alias("reason"))
    )


def import_decision(items: DataFrame, scripts: DataFrame) -> DataFrame:
    """Per imported script: write, skip (same content is there) or conflict."""
    there = scripts.select(
        "db_id", F.col("name").alias("target_name"), F.col("checksum").alias("existing_checksum")
    )
    decision = (
        F.when(F.col("existing_checksum").isNull(), "write")
        .when(F.col("existing_checksum") == F.col("checksum"), "skip")
        .otherwise("conflict")
    )
    return items.join(there, ["db_id", "target_name"], "left").withColumn("decision", decision)

