"""Another tool's journal and ledger, and the dialect of each database."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import read_files
from tidemark.sources.schemas import FOREIGN_LEDGER, JOURNAL

# Dialect spellings and the drivers that can be handled.
POSTGRES_ALIASES = ("pg", "postgresql")
SQLITE_ALIASES = ("sqlite", "turso", "libsql")
DRIVERS = ("postgres", "sqlite")


def dialect_of(alias: Column) -> Column:
    """A journal's dialect; null when it is not supported."""
    return F.when(alias.isin(*POSTGRES_ALIASES), "postgres").when(
        alias.isin(*SQLITE_ALIASES), "sqlite"
    )


# Fixed value: where the tool keeps its journal, from its own folder on.
JOURNAL_FILE = "meta/_journal.json"


def read_journals(spark: SparkSession, root: str, at: str = JOURNAL_FILE) -> DataFrame:
    """``root/db_id=<id>/meta/_journal.json`` (or another path ``at``): db_id, dialect, entries.

    A folder without the file has no journal; one that is no JSON object gives nulls.
    """
    found = read_files(spark, root, at=at)
    read = F.from_json(F.col("content").cast("string"), JOURNAL).alias("_j")
    return found.select("db_id", read).select("db_id", "_j.dialect", "_j.entries")


def entries(journals: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per entry in journal order: db_id, place, idx, pos, when, tag, and the
    journal's columns named in ``carry``.

    Entries sort by ``idx``, equal ones by their position in the file.  The sort stays
    inside the file's own array, so nothing is shuffled.
    """
    numbered = F.transform(
        "entries",
        lambda e, i: F.struct(e["idx"].alias("idx"), i.alias("pos"), e["when"].alias("when"), e["tag"].alias("tag")),
    )
    # The outer form keeps Catalyst from sorting the array once more as a filter.
    placed = F.posexplode_outer(F.sort_array(numbered)).alias("place", "_e")
    rows = journals.select("db_id", *carry, placed)
    return rows.where(F.col("place").isNotNull()).select("db_id", *carry, "place", "_e.*")


def read_foreign(spark: SparkSession, path: str) -> DataFrame:
    """The other tool's ledger at ``path``; one that does not exist is a fresh database's."""
    try:
        return spark.read.schema(FOREIGN_LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FOREIGN_LEDGER)


def foreign_rows(rows: DataFrame) -> DataFrame:
    """The other tool's ledger with ``created_at`` as a number; unreadable ones are 0."""
    return rows.select(
        "db_id",
        F.coalesce("hash", F.lit("")).alias("hash"),
        F.coalesce(F.expr("try_cast(created_at AS bigint)"), F.lit(0)).alias("created_at"),
    )


def dialects(wanted: DataFrame, configured: DataFrame) -> DataFrame:
    """Outcome per wanted database: ok with its dialect, not_configured or unsupported."""
    found = configured.select("db_id", "driver", F.lit(True).alias("_known"))
    driver = F.coalesce("driver", F.lit(""))
    outcome = (
        F.when(F.col("_known").isNull(), "not_configured")
        .when(driver.isin(*DRIVERS), "ok")
        .otherwise("unsupported")
    )
    return wanted.select("db_id").join(found, "db_id", "left").select(
        "db_id",
        outcome.alias("outcome"),
        F.when(outcome == "ok", driver).alias("dialect"),
    )
