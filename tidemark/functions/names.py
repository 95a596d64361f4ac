"""Script names: validation, the time prefix, slugs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = Column | datetime | str  # an instant in UTC

# The reasons a name is refused, in the order they are tested.
NO_EXTENSION = "missing .sql extension"
TOO_SHORT = "name too short"
BAD_PREFIX = "prefix must be a 14-digit timestamp (YYYYMMDDHHMMSS)"
NO_UNDERSCORE = "timestamp must be followed by `_slug`"
EMPTY_SLUG = "slug must not be empty"
BAD_SLUG = "slug may only contain [A-Za-z0-9_-]"
BAD_REQUEST = "slug must be non-empty and only contain [A-Za-z0-9_-]"
DEFAULT_SLUG = "migration"
WELL_FORMED = r"^[0-9]{14}_[A-Za-z0-9_-]+\.sql\z"
CLOCK_SKEW_MINUTES = 5
FIRST_SECOND = -62135596800  # 0001-01-01 00:00:00
LAST_SECOND = 253402300799  # 9999-12-31 23:59:59, the last one with a 14-digit form

# Fixed value: the code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def invalid_reason(name: Column) -> Column:
    """Why a script name is refused, or null when it is well formed."""
    stem = F.substr(name, F.lit(1), F.char_length(name) - 4)
    head = F.substring(stem.cast("binary"), 1, 14)  # bytes: a name is measured in bytes
    rest = F.substr(name, F.lit(16), F.greatest(F.char_length(name) - 19, F.lit(0)))
    return (
        F.when(is_valid(name), F.lit(None))
        .when(~F.endswith(name, F.lit(".sql")), NO_EXTENSION)
        .when((F.octet_length(stem) < 14) | ~F.is_valid_utf8(head.cast("string")), TOO_SHORT)
        .when(~stem.rlike("^[0-9]{14}"), BAD_PREFIX)
        .when(F.substring(stem, 15, 1) != "_", NO_UNDERSCORE)
        .when(rest == "", EMPTY_SLUG)
        .when(~rest.rlike(r"^[A-Za-z0-9_-]+\z"), BAD_SLUG)
    )


def is_valid(name: Column) -> Column:
    """Well formed; the same names for which ``invalid_reason`` is null.

    One match with one reference to the name, so that it stays cheap as a filter, also
    where Catalyst puts the expression behind ``name`` in its place.
    """
    return name.rlike(WELL_FORMED)


def instant(name: Column) -> Column:
    """The UTC instant of the 14-digit prefix; null when it is no calendar time.

    A second of 60 is no calendar time here.
    """
    digits = F.regexp_extract(name, "^[0-9]{14}", 0)
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def is_future_dated(name: Column, now: Moment) -> Column:
    """Ahead of ``now`` by more than the clock-skew allowance; unparsable is false."""
    limit = F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(CLOCK_SKEW_MINUTES))
    return F.coalesce(instant(name) > limit, F.lit(False))


def prefix_of(seconds: Column) -> Column:
    """14-digit UTC form of epoch seconds; null outside the years 1 to 9999."""
    in_range = F.when(seconds.between(FIRST_SECOND, LAST_SECOND), seconds)
    moment = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        secs=in_range.cast("decimal(18,6)")
    )
    return F.date_format(moment, "yyyyMMddHHmmss")


def epoch_seconds(moment: Column) -> Column:
    """Whole seconds since 1970 of a zone-free instant, rounded down."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), moment)


def tag_slug(tag: Column) -> Column:
    """Slug of another tool's tag: index prefix dropped, odd characters replaced."""
    stem = F.regexp_replace(tag, "^[0-9]+_", "")
    slug = F.regexp_replace(stem, "[^A-Za-z0-9_-]", "_")
    return F.when(slug == "", DEFAULT_SLUG).otherwise(slug)


def requested_slug(text: Column) -> Column:
    """A requested slug after trimming; null when it is refused."""
    slug = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(slug.rlike(r"^[A-Za-z0-9_-]+\z"), slug)
