"""Column choice and word rules that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the sense of every word rule here: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
#: What separates ASCII letters, digits and all non-ASCII characters.
BETWEEN_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character outside ASCII whose lower case is an ASCII letter, and a stand-in.
KELVIN, OTHER_LETTER = "\u212a", "\ua7b1"

#: bytes.translate table for the second word rule: lower case, separators to spaces.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``; a null text becomes the empty one."""
    return docs.select(
        named(doc_id).alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text")
    )


def lower_for_ascii(text: Column) -> Column:
    """Lower case; ASCII words come out as if only A to Z had been lowered."""
    return F.lower(F.replace(text, F.lit(KELVIN), F.lit(OTHER_LETTER)))


def space_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def raw(column) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null becomes the empty text."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]
