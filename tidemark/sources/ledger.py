"""Applied ledgers: read, check, append."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import Moment
from tidemark.sources.schemas import LEDGER

#: Column that partitions a ledger by the run that recorded its rows.
RUN = "recorded_by"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; a ledger that does not exist yet is empty.

    Of a script that several runs recorded, the row of the least run counts.
    """
    try:
        found = spark.read.schema(LEDGER + f", {RUN} string").parquet(path)
        key = ["db_id", "name"]
        by_run = found.where(F.col(RUN).isNotNull() & F.col("name").isNotNull() & F.col("db_id").isNotNull())
        first = F.min(F.struct(RUN, "checksum", "applied_at")).alias("_f")
        once = by_run.groupBy(*key).agg(first).select(*key, "_f.checksum", "_f.applied_at")
        rest = found.where(F.col(RUN).isNull() | F.col("name").isNull() | F.col("db_id").isNull())
        has_runs = RUN in spark.read.parquet(path).columns
        return rest.drop(RUN).unionByName(once) if has_runs else found.drop(RUN)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def sound(ledger: DataFrame) -> DataFrame:
    """Rows with a name and a checksum."""
    return ledger.where(F.col("name").isNotNull() & F.col("checksum").isNotNull())


def broken(ledger: DataFrame) -> DataFrame:
    """Rows without a name or a checksum, with the error they stand for."""
    field = F.when(F.col("name").isNull(), "name").when(F.col("checksum").isNull(), "checksum")
    return ledger.withColumn("missing_field", field).where(field.isNotNull())


def first_broken(ledger: DataFrame) -> DataFrame:
    """Per database with a row that cannot be used, the first of them: db_id, file, reason."""
    reason = F.concat(F.lit("ledger row without "), F.col("missing_field"))
    worst = F.min(F.struct(F.col("name").alias("file"), reason.alias("reason"))).alias("_w")
    return broken(ledger).groupBy("db_id").agg(worst).select("db_id", "_w.*")


def new_rows(ledger: DataFrame, scripts: DataFrame, now: Moment) -> DataFrame:
    """Ledger rows for the scripts not recorded yet."""
    return (
        scripts.select("db_id", "name", "checksum")
        .join(ledger.select("db_id", "name"), ["db_id", "name"], "left_anti")
        .withColumn("applied_at", F.lit(now).cast("timestamp_ntz"))
    )


def append(rows: DataFrame, path: str, run: str) -> None:
    """Record ``rows`` under the name of a run, in one job.

    Repeating a run replaces its own rows and no others, so an append that broke off, or was
    sent twice, leaves every row once. Runs that record the same script at the same time
    both write it: ``read_ledger`` takes the least run's row, and ``recorded_twice`` tells.
    """
    (
        rows.select("db_id", "name", "checksum", "applied_at", F.lit(run).alias(RUN))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(RUN)
        .parquet(path)
    )


def recorded_twice(spark: SparkSession, path: str) -> DataFrame:
    """Scripts that more than one run recorded: db_id, name, runs, agree (one checksum)."""
    rows = spark.read.schema(LEDGER + f", {RUN} string").parquet(path)
    return (
        rows.where(F.col(RUN).isNotNull())
        .groupBy("db_id", "name")
        .agg(F.sort_array(F.collect_set(RUN)).alias("runs"), (F.count_distinct("checksum") == 1).alias("agree"))
        .where(F.size("runs") > 1)
    )
