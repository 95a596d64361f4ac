"""Facts read out of index and trigger DDL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_upper

# Fixed values.
UNIQUE_INDEX = "CREATE UNIQUE INDEX"
TRIGGER_EVENTS = ("DELETE", "INSERT", "UPDATE")
_MEMBER = r"^\S+(?:\s+(?:ASC|DESC|NULLS|FIRST|LAST))*\z"


def index_columns(definition: Column) -> Column:
    """Column names of an index, empty as soon as one member is not a plain column."""
    inner = F.regexp_extract(definition, r"^[^(]*\(([^()]*)\)", 1)
    members = F.transform(F.split(inner, ","), lambda m: F.regexp_replace(m, r"^\s+|\s+\z", ""))
    plain = F.transform(
        members,
        lambda m: F.regexp_replace(F.regexp_extract(m, r"^\S+", 0), '^"+|"+\\z', ""),
    )
    return F.when(F.forall(members, lambda m: m.rlike(_MEMBER)), plain).otherwise(
        F.array().cast("array<string>")
    )


def index_is_unique(definition: Column) -> Column:
    return F.startswith(definition, F.lit(UNIQUE_INDEX))


def _trigger_header(sql: Column) -> Column:
    return F.substring_index(ascii_upper(F.coalesce(sql, F.lit(""))), " ON ", 1)


def trigger_timing(sql: Column) -> Column:
    """``INSTEAD OF``, ``BEFORE`` or, when neither is named, ``AFTER``."""
    header = _trigger_header(sql)
    return (
        F.when(F.contains(header, F.lit("INSTEAD OF")), "INSTEAD OF")
        .when(F.contains(header, F.lit("BEFORE")), "BEFORE")
        .otherwise("AFTER")
    )


def trigger_events(sql: Column) -> Column:
    """Events named before the ``ON`` clause, in alphabetical order."""
    header = _trigger_header(sql)
    return F.filter(
        F.array(*[F.lit(e) for e in TRIGGER_EVENTS]), lambda e: F.contains(header, e)
    )
