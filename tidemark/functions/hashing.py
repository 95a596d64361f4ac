"""Content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checksum(content: Column) -> Column:
    """SHA-256 with CRLF read as LF; a lone CR is content and stays.

    The bytes travel as an unvalidated string, whose ``replace`` works bytewise, so
    content that is no valid UTF-8 hashes correctly too.
    """
    unix = F.replace(content.cast("string"), F.lit("\r\n"), F.lit("\n"))
    return F.sha2(unix.cast("binary"), 256)


def raw_checksum(content: Column) -> Column:
    """SHA-256 of the bytes as they are."""
    return F.sha2(content.cast("binary"), 256)
