"""ASCII-only text helpers shared by the other expression modules."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_upper(c: Column) -> Column:
    """Upper-case a-z only; ``upper`` would also fold non-ASCII letters."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def pascal_case(name: Column) -> Column:
    """``order_items`` / ``order-items`` / ``order items`` -> ``OrderItems``."""
    words = F.filter(F.split(name, "[_\\- ]"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(ascii_upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))),
        "",
    )


def quoted(c: Column) -> Column:
    """Single-quoted text with inner quotes escaped by a backslash."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))


def property_name(name: Column) -> Column:
    """The name itself when it is an identifier, else the quoted name."""
    return F.when(name.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*\z"), name).otherwise(quoted(name))
