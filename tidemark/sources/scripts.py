"""Script files: scan, name check, fingerprint, split verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import checksum
from tidemark.functions.names import invalid_reason, is_valid
from tidemark.functions.statements import split, verdict
from tidemark.operators.keyed import attach
from tidemark.session import pin
from tidemark.sources.files import read_files


def read_scripts(spark: SparkSession, root: str) -> DataFrame:
    """``*.sql`` files directly under ``root/db_id=<id>/``: db_id, name, path, content.

    The content is only read when a later step selects it.  Spark's listing hides names
    beginning with ``_`` or ``.``; they are listed apart, without their content, as no such
    name is valid.
    """
    hidden = read_files(spark, root, suffix=".sql", hidden="true", content="false")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.sql")
        .load(root)
    )
    layout = r"/db_id=([^/]+)/([^/]+\.sql)$"
    shown = files.where(F.col("path").rlike(layout)).select(
        F.regexp_extract("path", layout, 1).alias("db_id"),
        F.regexp_extract("path", layout, 2).alias("name"),
        "path",
        "content",
    )
    return shown.unionByName(hidden)


#: Keys up to which a list of scripts is sent to every task of a scan.
FEW_SCRIPTS = 200_000


def scan(files: DataFrame, verdicts: bool = False, recorded: DataFrame | None = None) -> DataFrame:
    """One narrow row per ``.sql`` file: db_id, name, reason, checksum; with
    ``verdicts`` also ok, statements and error of the split.

    ``reason`` says why a name is refused; such files are not read, so their checksum
    is null.  Hashing (and, with ``verdicts``, splitting) happens in the scan stage, so
    the content itself is never shuffled, and checksum and verdict come from the same bytes.

    ``recorded`` (db_id, name) lists scripts that need no verdict.  Up to ``FEW_SCRIPTS``
    of them the list travels to the scan and they are not split, with a verdict of null;
    of more, all are split, as that costs less than to read or shuffle contents again.
    """
    name = F.col("name")
    known = None
    if verdicts and recorded is not None:
        listed = recorded.select("db_id", "name").distinct().limit(FEW_SCRIPTS + 1)
        known = pin(listed)
        known = F.broadcast(known.withColumn("_known", F.lit(True))) if known.count() <= FEW_SCRIPTS else None
    kept = files.where(name.rlike(r"[\s\S]\.sql\z"))  # a bare ".sql" has no extension
    named = kept.select(
        "db_id",
        "name",
        invalid_reason(name).alias("reason"),
        F.when(is_valid(name), F.col("content")).alias("content"),
    )
    hashed = named.withColumn("checksum", checksum(F.col("content")))
    if not verdicts:
        return hashed.drop("content")
    if known is None:
        return verdict(split(hashed)).drop("content")
    open_ = F.when(F.col("_known").isNull(), F.col("content"))
    judged = verdict(split(hashed.join(known, ["db_id", "name"], "left").withColumn("content", open_)))
    shown = {c: F.when(F.col("_known").isNull(), F.col(c)) for c in ("ok", "statements", "error")}
    return judged.withColumns(shown).drop("content", "_known")


def valid(scanned: DataFrame) -> DataFrame:
    """Well-named scripts."""
    return scanned.where(is_valid(F.col("name"))).drop("reason")


def invalid(scanned: DataFrame) -> DataFrame:
    """Ill-named scripts: db_id, file, reason."""
    return scanned.where(~is_valid(F.col("name"))).select(
        "db_id", F.col("name").alias("file"), "reason"
    )


def first_invalid(scanned: DataFrame) -> DataFrame:
    """Per database with ill-named scripts, the first of them."""
    worst = F.min(F.struct("file", "reason")).alias("_w")
    return invalid(scanned).groupBy("db_id").agg(worst).select("db_id", "_w.file", "_w.reason")


def scan_strict(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scripts, errors): one ill-named script takes its whole database out."""
    errors = first_invalid(scanned)
    scripts = attach(valid(scanned), errors, ["db_id"], how="left_anti")
    return scripts, errors


def statements(files: DataFrame) -> DataFrame:
    """Statements of each script in order: db_id, name, pos, statement."""
    parts = split(files.select("db_id", "name", "content"))
    # The outer form keeps Catalyst from computing the split once more as a filter.
    return parts.select(
        "db_id", "name", F.posexplode_outer("statements").alias("pos", "statement")
    ).where(F.col("pos").isNotNull())


def verdicts(files: DataFrame) -> DataFrame:
    """Per script: db_id, name, ok, statements, error.  Empty scripts are kept."""
    return verdict(split(files.select("db_id", "name", "content"))).drop("content")
