"""Table changes on large tables, and the check of a copy.

The changes are narrow projections: they read and write each row once and never
shuffle.  Results are written beside the old table and swapped in by location.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import exact, free_names, quoted


def add_column(df: DataFrame, name: str, dtype: str, default=None) -> DataFrame:
    """A new column, null or with a default for the rows already there."""
    return df.withColumn(name, F.lit(default).cast(dtype))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def _fitted(df: DataFrame, column: str, dtype: str) -> Column:
    """``try_cast`` that does not even try numbers outside the new type's range.

    A failing cast costs an exception per row; a comparison costs next to nothing.
    """
    source, c = df.schema[column].dataType, exact(column)
    target = T.DataType.fromDDL(dtype)
    if not isinstance(source, T.NumericType):
        return c.try_cast(dtype)
    if isinstance(target, T.DecimalType):
        limit = 10.0 ** (target.precision - target.scale)
    elif isinstance(target, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        bits = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}[target.simpleString()]
        limit = 2.0**bits + 1
    else:
        return c.try_cast(dtype)
    return F.when(F.abs(c.cast("double")) <= limit, c.try_cast(dtype))


def change_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; ``rejected`` lists those whose value does not fit the new type."""
    (packed,) = free_names("_new", df)
    values = F.struct(*[_fitted(df, c, t).alias(f"v{k}") for k, (c, t) in enumerate(types.items())])
    fitted = df.withColumn(packed, values) if types else df
    new = {c: F.col(packed)[f"v{k}"] for k, c in enumerate(types)}
    lost = [F.when(exact(c).isNotNull() & new[c].isNull(), F.lit(c)) for c in types]
    shown = [new[c].alias(c) if c in types else exact(c) for c in df.columns]
    rejected = F.array_compact(F.array(*lost)) if lost else F.array().cast("array<string>")
    return fitted.select(*shown, rejected.alias("rejected"))


def split_rejects(changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a type change."""
    clean = F.size("rejected") == 0
    return changed.where(clean).drop("rejected"), changed.where(~clean)


def recreate(df: DataFrame, shape: Sequence[tuple[str, str, Column | None]]) -> DataFrame:
    """The table in a new shape: (name, type, expression), in the order given.

    Without an expression the column of the same name is taken over.
    """
    return df.select(
        *[(exact(n) if e is None else e).cast(t).alias(n) for n, t, e in shape]
    )


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a new version beside the old one; fails if the place is taken."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def swap_location(spark: SparkSession, table: str, path: str) -> None:
    """Point a catalogue table at its new version: readers see either all or nothing.

    ``table`` is a name or names joined by dots; a name itself holds none.
    """
    named = ".".join(quoted(part) for part in table.split("."))
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {named} SET LOCATION '{place}'")
    spark.catalog.refreshTable(table)


def copy_differences(
    source: DataFrame, copy: DataFrame, key: Sequence[str], columns: Sequence[str], buckets: int = 4096
) -> DataFrame:
    """Keys under which two copies differ: key, state (missing, extra or different).

    One pass digests both sides per bucket of the key's hash; copies that agree are done then.
    Otherwise only rows of buckets that differ are read again and compared by key. Rows of one
    key are compared as a bag, so a key need not be unique, and a null is a value like any.
    """
    bucket = F.pmod(F.xxhash64(F.lit(7), *map(exact, key)), F.lit(buckets))
    parts = [x for c in columns for x in (exact(c), exact(c).isNull())]
    own = free_names("_sign _bucket _one _two", source, copy)
    sign, at, one, two = own
    sides = [
        df.select(
            *map(exact, key),
            F.lit(s).alias(sign),
            bucket.alias(at),
            F.xxhash64(*parts).cast("decimal(38,0)").alias(one),
            F.xxhash64(F.lit(1), *parts).cast("decimal(38,0)").alias(two),
        )
        for df, s in ((source, 1), (copy, -1))
    ]
    both = sides[0].unionByName(sides[1])
    sums = [F.sum(F.col(x) * F.col(sign)).alias(x) for x in (one, two)]
    differs = (F.col(one) != 0) | (F.col(two) != 0) | (F.col("_left") != 0)
    digests = both.groupBy(at).agg(*sums, F.sum(sign).alias("_left"))
    unequal = [r[0] for r in digests.where(differs).select(at).collect()]
    n_source, n_copy = (F.count_if(F.col(sign) == s) for s in (1, -1))
    state = F.when(F.col("_copy") == 0, "missing").when(F.col("_source") == 0, "extra").otherwise("different")
    return (
        both.where(F.col(at).isin(unequal))
        .groupBy(*map(exact, key))
        .agg(*sums, F.sum(sign).alias("_left"), n_source.alias("_source"), n_copy.alias("_copy"))
        .where(differs)
        .select(*map(exact, key), state.alias("state"))
    )


def copy_verify(source: DataFrame, copy: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: row counts of both sides and whether they hold the same rows.

    The digest does not depend on order or partitioning and is combined map-side; only
    one row per task is exchanged.
    """
    # The hash skips nulls, so each column also says whether it is one.
    parts = [x for c in columns for x in (exact(c), exact(c).isNull())]
    sides = [
        df.select(
            F.lit(sign).alias("_sign"),
            F.xxhash64(*parts).alias("_one"),
            F.xxhash64(F.lit(1), *parts).alias("_two"),
        )
        for df, sign in ((source, 1), (copy, -1))
    ]
    mine = F.col("_sign") == 1
    balance = F.sum(F.col("_one").cast("decimal(38,0)") * F.col("_sign"))
    return (
        sides[0]
        .unionByName(sides[1])
        .agg(
            F.count_if(mine).alias("rows_source"),
            F.count_if(~mine).alias("rows_copy"),
            F.coalesce(balance, F.lit(0)).alias("_balance"),
            F.coalesce(F.bit_xor("_two"), F.lit(0)).alias("_xor"),
        )
        .select(
            "rows_source",
            "rows_copy",
            (
                (F.col("rows_source") == F.col("rows_copy"))
                & (F.col("_balance") == 0)
                & (F.col("_xor") == 0)
            ).alias("matches"),
        )
    )
