"""Declared keys and domains, tested on large tables.

Rows are counted per key before they are shuffled, so a key that holds much of a table
costs one row per task.  Results name each offending key with its number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.columns import exact, free_names
from tidemark.operators.keyed import attach
from tidemark.session import pin


def _all_set(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & exact(c).isNotNull()
    return out


def primary_key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or have an unset part."""
    return (
        df.groupBy(*map(exact, key))
        .agg(F.count("*").alias("n_rows"))
        .where((F.col("n_rows") > 1) | ~_all_set(key))
    )


def unique_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Values that occur more than once; keys with an unset part never collide."""
    return (
        df.where(_all_set(key))
        .groupBy(*map(exact, key))
        .agg(F.count("*").alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def foreign_key_violations(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, references: Sequence[str]
) -> DataFrame:
    """Child keys without a parent row; keys with an unset part are exempt."""
    used = child.where(_all_set(columns)).groupBy(*map(exact, columns)).agg(F.count("*").alias("n_rows"))
    known = parent.select(*[exact(r).alias(c) for c, r in zip(columns, references)]).distinct()
    return used.join(known, list(columns), "left_anti")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unset values per not-null column, all in one pass: column_name, n_nulls."""
    counts = df.agg(*[F.count_if(exact(c).isNull()).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column_name"), exact(c).alias("n_nulls")) for c in columns]
    return counts.select(F.inline(F.array(*pairs)))


def enum_violations(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Values outside the enum's labels, with their number of rows; null is allowed."""
    used = df.where(exact(column).isNotNull()).groupBy(exact(column)).agg(F.count("*").alias("n_rows"))
    return used.join(labels.select(F.col("label").alias(column)), [column], "left_anti")


@dataclass(frozen=True)
class Declared:
    """What a table declares about its own rows: ``kind`` is primary key, unique, not null or enum."""

    kind: str
    name: str
    columns: tuple[str, ...]
    labels: tuple[str, ...] = ()


def declared(report: Row, enums: Mapping[str, Sequence[str]] | None = None) -> list[Declared]:
    """The declarations in one row of a schema report.

    Unique indexes over expressions are left out, and those with a condition, as they declare
    nothing about the columns of all rows; ``enums`` gives the labels of the types that are
    enums. Members of the primary key are not null by it alone.
    """
    key = tuple(report["primary_key"] or ())
    out = [Declared("primary key", "primary key", key)] if key else []
    for i in report["indexes"] or ():
        whole = i["definition"] is None or " WHERE " not in i["definition"].upper()
        if i["is_unique"] and i["columns"] and whole and tuple(i["columns"]) != key:
            out.append(Declared("unique", i["index_name"], tuple(i["columns"])))
    for c in report["columns"]:
        if not c["nullable"] and c["column_name"] not in key:
            out.append(Declared("not null", c["column_name"], (c["column_name"],)))
        if enums and c["data_type"] in enums:
            out.append(Declared("enum", c["column_name"], (c["column_name"],), tuple(enums[c["data_type"]])))
    return out


def declared_violations(df: DataFrame, rules: Sequence[Declared]) -> DataFrame:
    """kind, name, key (its values as JSON), n_rows: what breaks any of ``rules``, in one pass.

    Every row is read once and gives one counted entry per key it must be unique by, and one
    per rule it breaks by itself; entries are counted before they are shuffled, so the shuffle
    holds the keys once each. A key breaks its rule where it occurs more than once, a primary
    key also where a part is unset; unset parts never collide in a unique index, and are
    allowed in an enum.
    """
    entries = []
    for n, r in enumerate(rules):
        parts = F.struct(*[exact(c).alias(c) for c in r.columns])
        key = F.to_json(parts, {"ignoreNullFields": "false"})
        alone = ~_all_set(r.columns)
        if r.kind == "primary key":
            counted = F.lit(True)
        elif r.kind == "unique":
            counted, alone = _all_set(r.columns), F.lit(False)
        elif r.kind == "not null":
            counted = alone
        elif r.kind == "enum":
            alone = _all_set(r.columns) & ~exact(r.columns[0]).cast("string").isin(*r.labels)
            counted = alone
        else:
            raise ValueError(f"no check for {r.kind}")
        entry = F.struct(F.lit(n).alias("rule"), key.alias("key"), alone.alias("alone"))
        entries.append(F.when(counted, entry))
    shape = "kind string, name string, key string, n_rows bigint"
    if not entries:
        return df.sparkSession.createDataFrame([], shape)
    one = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    counts = one.groupBy("rule", "key", "alone").agg(F.count("*").alias("n_rows"))
    bad = counts.where(F.col("alone") | (F.col("n_rows") > 1))
    kinds, names = (F.array(*[F.lit(getattr(r, f)) for r in rules]) for f in ("kind", "name"))
    return bad.select(F.get(kinds, "rule").alias("kind"), F.get(names, "rule").alias("name"), "key", "n_rows")


def after_delete(
    child: DataFrame, columns: Sequence[str], deleted: DataFrame, references: Sequence[str], action: str
) -> DataFrame:
    """Child rows after their parents are deleted: CASCADE drops, SET NULL unsets.

    One level; ``delete_rows`` follows the keys of all tables.  One parent may have very
    many children.
    """
    gone = deleted.select(*[exact(r).alias(c) for c, r in zip(columns, references)]).distinct()
    if action == "CASCADE":
        return attach(child, gone, list(columns), how="left_anti").select(*map(exact, child.columns))
    if action != "SET NULL":
        raise ValueError(f"no rewrite for ON DELETE {action}")
    (mark,) = free_names("_gone", child)
    marked = attach(child, gone.withColumn(mark, F.lit(True)), list(columns))
    kept = [F.when(F.col(mark).isNull(), exact(c)).alias(c) if c in columns else exact(c) for c in child.columns]
    return marked.select(*kept)


@dataclass(frozen=True)
class ForeignKey:
    """``child``'s ``columns`` refer to ``parent``'s ``references``."""

    child: str
    columns: tuple[str, ...]
    parent: str
    references: tuple[str, ...]
    on_delete: str = "NO ACTION"


def delete_rows(
    tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey], deleted: Mapping[str, DataFrame]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables after rows are deleted and every ON DELETE has been followed.

    ``deleted`` holds, per table, rows to delete: values of some of its columns, and every
    row that matches goes.  CASCADE deletes children, their children and so on, SET NULL
    unsets the referring columns; a row that one key unsets and another deletes is deleted.
    Any other action refuses: ``refused`` lists (child, columns, parent, n_rows) of keys whose
    rows would still refer to a deleted parent, and then no table is to be replaced.  Keys
    may refer to their own table or form cycles, and have several columns; one with an unset
    part refers to nothing.

    What is deleted is held as values that keys refer to, not as rows. A round takes the rows
    that the values new in the round before delete, and of those the values that further
    keys refer to; values known already are left out, so cycles end. There are as many rounds
    as the longest chain of deletions; each reads only key columns, and its values are
    written to the shared folder, so that no round computes an earlier one again.
    """
    known: list[list[DataFrame]] = [[] for _ in keys]
    fresh = {t: [(rows.distinct(), tuple(rows.columns))] for t, rows in deleted.items()}
    while fresh:
        new: dict[str, list] = {}
        for k, before in zip(keys, known):
            hits = [attach(tables[k.parent], rows, list(on), how="left_semi") for rows, on in fresh.get(k.parent, [])]
            if not hits:
                continue
            named = [exact(r).alias(c) for c, r in zip(k.columns, k.references)]
            values = _union([h.select(*named) for h in hits]).where(_all_set(k.columns)).distinct()
            if before:
                values = values.join(_union(before), list(k.columns), "left_anti")
            values = pin(values)
            if not values.isEmpty():
                before.append(values)
                if k.on_delete == "CASCADE":
                    new.setdefault(k.child, []).append((values, k.columns))
        fresh = new
    met = [(k, _union(values)) for k, values in zip(keys, known) if values]
    after, refused = {}, []
    for t, df in tables.items():
        left = attach(df, deleted[t].distinct(), list(deleted[t].columns), how="left_anti") if t in deleted else df
        mine = [(k, values) for k, values in met if k.child == t]
        for k, values in mine:
            if k.on_delete == "CASCADE":
                left = attach(left, values, list(k.columns), how="left_anti")
        for k, values in mine:
            if k.on_delete not in ("CASCADE", "SET NULL"):
                rows = attach(left, values, list(k.columns), how="left_semi").agg(F.count("*").alias("n_rows"))
                listed = F.array(*map(F.lit, k.columns)).alias("columns")
                refused.append(rows.where("n_rows > 0").select(F.lit(t).alias("child"), listed, F.lit(k.parent).alias("parent"), "n_rows"))
        # Every key looks at the row as it was, so all marks are set before anything is unset.
        unset = [(k, values) for k, values in mine if k.on_delete == "SET NULL"]
        marks = free_names(" ".join(f"_gone{i}" for i in range(len(unset))), df)
        for (k, values), mark in zip(unset, marks):
            left = attach(left, values.withColumn(mark, F.lit(True)), list(k.columns))
        shown = []
        for c in df.columns:
            cut = [F.col(m).isNotNull() for (k, _), m in zip(unset, marks) if c in k.columns]
            shown.append(F.when(~reduce(Column.__or__, cut), exact(c)).alias(c) if cut else exact(c))
        after[t] = left.select(*shown)
    none = next(iter(tables.values())).sparkSession.createDataFrame([], _REFUSED)
    return after, _union([none, *refused])


_REFUSED = "child string, columns array<string>, parent string, n_rows bigint"


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def audit_changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """INSERT, UPDATE and DELETE rows between two snapshots with a unique key."""
    rest = [c for c in before.columns if c not in key]
    keys = [*map(exact, key)]
    old = before.select(*keys, F.struct(*map(exact, rest)).alias("old_row"))
    new = after.select(*keys, F.struct(*map(exact, rest)).alias("new_row"))
    op = F.when(F.col("old_row").isNull(), "INSERT").when(
        F.col("new_row").isNull(), "DELETE"
    ).otherwise("UPDATE")
    return (
        old.join(new, list(key), "full_outer")
        .where(~F.col("old_row").eqNullSafe(F.col("new_row")))
        .select(*keys, op.alias("op"), "old_row", "new_row")
    )
