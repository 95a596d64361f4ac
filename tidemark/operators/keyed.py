"""Building blocks that stay even when one key owns much of the rows.

``attach`` joins rows to a lookup of one row per key, ``meet`` two listings that are both
large; ``placed`` and ``rising`` compute
positions and running maxima over a whole history without one task seeing it all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import exact, free_names
from tidemark.session import pin

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def attach(
    rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", large: bool = False
) -> DataFrame:
    """Join ``rows`` to ``lookup``, which holds at most one row per key.

    No side is hinted: Spark broadcasts the lookup where its size, known to AQE at run
    time, stays under the broadcast threshold.  Beyond it one key may still own much of
    ``rows`` (nulls included), and AQE splits its partition over many tasks -- but only
    where both sides come straight from a shuffle.  A lookup made by ``groupBy`` is
    already partitioned by the key and would not be shuffled again; the key's hash as
    a second join column sees to it.  A ``large`` lookup grows with the fleet and is merged,
    as in ``meet``.
    """
    (tag,) = free_names("_hash", rows, lookup)
    value = F.xxhash64(*map(exact, on))
    tagged = lookup.withColumn(tag, value)
    return rows.withColumn(tag, value).join(tagged.hint("merge") if large else tagged, [*on, tag], how).drop(tag)


def meet(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join two listings that both grow with the fleet: always sorted and merged.

    Without the hint Spark may broadcast ``other`` by an estimate made before anything has
    run, which does not see how many rows an array explodes into: a hash table of millions of
    rows in the driver and in every task.
    """
    return rows.join(other.hint("merge"), on, how)


_OWN = "_at _chunk _row _n _first _shift _top _carry _place"


def _sorted_rows(df: DataFrame, by: list[str], order: list[str], own: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted, each row with its chunk and row number.

    The chunks are balanced whatever the keys are.  They are pinned because their
    bounds come from sampling and two evaluations could differ.
    """
    at, chunk, row = own[:3]
    marked = pin(df.orderBy(*map(exact, [*by, *order])).withColumn(at, F.monotonically_increasing_id()))
    return marked.withColumn(chunk, F.shiftright(at, _ROW_BITS)).withColumn(
        row, F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )


def _before(by: list[str], chunk: str):
    """Earlier chunks of the same key: at most one row per chunk, so a small window."""
    return Window.partitionBy(*map(exact, by)).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)


def placed(df: DataFrame, by: list[str], order: list[str], position: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in its ``by`` group; ``order`` must be total."""
    own = free_names(_OWN, df)
    at, chunk, row, n, first, shift = own[:6]
    rows = _sorted_rows(df, by, order, own)
    keys = [*map(exact, by), F.col(chunk)]
    chunks = rows.groupBy(*keys).agg(F.count("*").alias(n), F.min(row).alias(first))
    earlier = F.coalesce(F.sum(n).over(_before(by, chunk)), F.lit(0))
    starts = chunks.select(*keys, (earlier - F.col(first)).alias(shift))
    out = rows.join(starts, [*by, chunk]).withColumn(position, F.col(row) + F.col(shift))
    return out.select(*[exact(c) for c in df.columns if c != position], exact(position))


def rising(
    df: DataFrame,
    by: list[str],
    order: list[str],
    value: str,
    floor: Column,
    result: str,
) -> DataFrame:
    """Add ``result``: the smallest strictly rising sequence not below ``value``.

    s(i) = max(value(i), s(i-1) + 1) with s(-1) = ``floor``, which has the closed form
    s(i) = i + max(floor + 1, max over j <= i of value(j) - j).  Counts and maxima are
    taken per chunk, carried over the chunks, and finished inside each chunk.
    """
    own = free_names(_OWN, df)
    at, chunk, row, n, first, shift, top, carry, place = own
    rows = _sorted_rows(df, by, order, own)
    keys = [*map(exact, by), F.col(chunk)]
    chunks = rows.groupBy(*keys).agg(
        F.count("*").alias(n), F.min(row).alias(first), F.max(exact(value) - F.col(row)).alias(top)
    )
    before = _before(by, chunk)
    starts = chunks.withColumn(shift, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first))
    carried = starts.select(*keys, shift, F.max(F.col(top) - F.col(shift)).over(before).alias(carry))
    inside = (
        Window.partitionBy(*keys).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = rows.join(carried, [*by, chunk]).withColumn(place, F.col(row) + F.col(shift))
    lead = F.max(exact(value) - F.col(place)).over(inside)
    out = joined.withColumn(result, F.col(place) + F.greatest(floor + 1, F.col(carry), lead))
    return out.select(*[exact(c) for c in df.columns if c != result], exact(result))
