"""Columns by their exact names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """The name between backticks, those inside doubled."""
    return "`" + name.replace("`", "``") + "`"


def exact(name: str) -> Column:
    """A column of that very name, dots and backticks included."""
    return F.col(quoted(name))


def free_names(wanted: str, *tables: DataFrame) -> list[str]:
    """Names, given apart by spaces, made longer until no table has a column of that name.

    Column names are compared without regard to case, as Spark does.
    """
    taken = {c.lower() for t in tables for c in t.columns}
    out = []
    for name in wanted.split():
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
