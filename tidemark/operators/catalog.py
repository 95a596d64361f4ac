"""Catalogue rows to schema reports.

Both dialects are brought to the same flat shapes, keyed by (db_id, table_name):

columns   column_name, data_type, nullable, default, position
keys      column_name, key_pos
foreign   fk_key, name, position, column_name, references_table, references_column,
          on_delete, on_update
indexes   index_name, is_unique, columns, definition
triggers  trigger_name, timing, events, definition

Collected lists hold the parts of one table, index, enum or constraint; the databases
themselves limit those to a few thousand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ddl
from tidemark.functions.text import ascii_upper
from tidemark.operators.keyed import attach, meet

TABLE = ["db_id", "table_name"]
# Action codes of Postgres foreign keys.
FK_ACTIONS = {
    "a": "NO ACTION",
    "r": "RESTRICT",
    "c": "CASCADE",
    "n": "SET NULL",
    "d": "SET DEFAULT",
}


def _number(name: str) -> Column:
    """A number that may arrive as text; anything unreadable is null."""
    return F.col(f"`{name}`").try_cast("bigint")


def _in_schema(rows: DataFrame, oid: str, namespace: DataFrame, schema: str) -> DataFrame:
    """Rows whose namespace is ``schema``: one lookup row per database."""
    spaces = namespace.where(F.col("nspname") == schema).select("db_id", F.col("oid").alias(oid))
    return attach(rows, spaces, ["db_id", oid], how="left_semi", large=True)


# -- Postgres ---------------------------------------------------------------------------


def pg_columns(columns: DataFrame, tables: DataFrame, schema: str = "public") -> DataFrame:
    """Columns of the base tables of one schema."""
    base = tables.where(
        (F.col("table_schema") == schema) & (F.col("table_type") == "BASE TABLE")
    ).select(*TABLE)
    return (
        columns.where(F.col("table_schema") == schema)
        .transform(meet, base, TABLE)
        .select(
            *TABLE,
            "column_name",
            "data_type",
            "udt_name",
            (F.col("is_nullable") == "YES").alias("nullable"),
            F.col("column_default").alias("default"),
            F.coalesce(_number("ordinal_position"), F.lit(0)).alias("position"),
        )
    )


def pg_keys(constraints: DataFrame, usage: DataFrame, schema: str = "public") -> DataFrame:
    """Primary-key columns with their place in the key."""
    on = ["db_id", "constraint_schema", "constraint_name"]
    primary = constraints.where(
        (F.col("table_schema") == schema) & (F.col("constraint_type") == "PRIMARY KEY")
    ).select(*on, "table_name")
    return meet(primary, usage, on).select(
        *TABLE, "column_name", _number("ordinal_position").alias("key_pos")
    )


def pg_foreign(
    constraint: DataFrame,
    classes: DataFrame,
    namespace: DataFrame,
    attribute: DataFrame,
    schema: str = "public",
) -> DataFrame:
    """Foreign-key columns, local and referenced ones paired by their place in the key."""
    pairs = constraint.where(F.col("contype") == "f").select(
        "db_id",
        "conname",
        "conrelid",
        "confrelid",
        "confdeltype",
        "confupdtype",
        F.posexplode(F.arrays_zip("conkey", "confkey")).alias("_n", "_pair"),
    )
    local = _in_schema(classes, "relnamespace", namespace, schema).select(
        "db_id", F.col("oid").alias("conrelid"), F.col("relname").alias("table_name")
    )
    remote = classes.select(
        "db_id", F.col("oid").alias("confrelid"), F.col("relname").alias("references_table")
    )
    here = attribute.select(
        "db_id",
        F.col("attrelid").alias("conrelid"),
        F.col("attnum").alias("_here"),
        F.col("attname").alias("column_name"),
    )
    there = attribute.select(
        "db_id",
        F.col("attrelid").alias("confrelid"),
        F.col("attnum").alias("_there"),
        F.col("attname").alias("references_column"),
    )
    codes = F.create_map(*[F.lit(x) for pair in FK_ACTIONS.items() for x in pair])
    return (
        pairs.withColumn("_here", F.col("_pair.conkey"))
        .withColumn("_there", F.col("_pair.confkey"))
        .transform(meet, local, ["db_id", "conrelid"])
        .transform(meet, here, ["db_id", "conrelid", "_here"])
        .transform(meet, remote, ["db_id", "confrelid"])
        .transform(meet, there, ["db_id", "confrelid", "_there"])
        .select(
            *TABLE,
            F.col("conname").alias("fk_key"),
            F.col("conname").alias("name"),
            (F.col("_n") + 1).cast("bigint").alias("position"),
            "column_name",
            "references_table",
            "references_column",
            F.try_element_at(codes, F.col("confdeltype")).alias("on_delete"),
            F.try_element_at(codes, F.col("confupdtype")).alias("on_update"),
        )
    )


def pg_enum_labels(
    types: DataFrame, enums: DataFrame, namespace: DataFrame, schema: str = "public"
) -> DataFrame:
    """Enum labels with their declared order: db_id, enum_name, label, label_order."""
    named = _in_schema(types, "typnamespace", namespace, schema).select(
        "db_id", F.col("oid").alias("enumtypid"), F.col("typname").alias("enum_name")
    )
    return meet(named, enums, ["db_id", "enumtypid"]).select(
        "db_id",
        "enum_name",
        F.col("enumlabel").alias("label"),
        F.col("enumsortorder").alias("label_order"),
    )


def pg_index_rows(indexes: DataFrame, schema: str = "public") -> DataFrame:
    definition = F.col("indexdef")
    return indexes.where(F.col("schemaname") == schema).select(
        "db_id",
        F.col("tablename").alias("table_name"),
        F.col("indexname").alias("index_name"),
        ddl.index_is_unique(definition).alias("is_unique"),
        ddl.index_columns(definition).alias("columns"),
        definition.alias("definition"),
    )


def pg_trigger_rows(triggers: DataFrame, schema: str = "public") -> DataFrame:
    """One row per trigger; the catalogue has one per trigger and event."""
    first = F.min_by(F.struct("action_timing", "action_statement"), "event_manipulation")
    return (
        triggers.where(F.col("trigger_schema") == schema)
        .groupBy("db_id", F.col("event_object_table").alias("table_name"), "trigger_name")
        .agg(F.sort_array(F.collect_list("event_manipulation")).alias("events"), first.alias("_f"))
        .select(
            *TABLE,
            "trigger_name",
            F.col("_f.action_timing").alias("timing"),
            "events",
            F.col("_f.action_statement").alias("definition"),
        )
    )


# -- SQLite -----------------------------------------------------------------------------


def sqlite_tables(master: DataFrame) -> DataFrame:
    """User tables; the engine's own names match ``sqlite_%``, where ``_`` is any letter."""
    own = ascii_upper(F.col("name")).like("SQLITE_%")
    return master.where((F.col("type") == "table") & ~own).select(
        "db_id", F.col("name").alias("table_name")
    )


def sqlite_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns of the user tables; members of the primary key are never null."""
    flag = F.coalesce(_number("notnull"), F.lit(0)) != 0
    return meet(tables, columns, TABLE).select(
        *TABLE,
        F.col("name").alias("column_name"),
        F.coalesce("type", F.lit("")).alias("data_type"),
        (~flag & (F.coalesce(_number("pk"), F.lit(0)) == 0)).alias("nullable"),
        F.col("dflt_value").alias("default"),
        F.coalesce(_number("cid") + 1, F.lit(0)).alias("position"),
    )


def sqlite_keys(tables: DataFrame, columns: DataFrame) -> DataFrame:
    return meet(tables, columns.where(_number("pk") > 0), TABLE).select(
        *TABLE, F.col("name").alias("column_name"), _number("pk").alias("key_pos")
    )


def sqlite_foreign(tables: DataFrame, foreign: DataFrame) -> DataFrame:
    """Foreign keys are unnamed; ``fk_key`` is the number that groups their columns."""
    return meet(tables, foreign, TABLE).select(
        *TABLE,
        _number("id").alias("fk_key"),
        F.lit(None).cast("string").alias("name"),
        _number("seq").alias("position"),
        F.col("from").alias("column_name"),
        F.col("table").alias("references_table"),
        F.col("to").alias("references_column"),
        "on_delete",
        "on_update",
    )


def sqlite_index_rows(
    tables: DataFrame, index_list: DataFrame, index_info: DataFrame, master: DataFrame
) -> DataFrame:
    """Indexes with their columns in order (expression members left out) and their DDL."""
    members = (
        index_info.where(F.col("name").isNotNull())
        .groupBy("db_id", "index_name")
        .agg(F.sort_array(F.collect_list(F.struct(_number("seqno").alias("n"), "name"))).alias("_m"))
    )
    texts = master.where(F.col("type") == "index").select(
        "db_id", F.col("name").alias("index_name"), F.col("sql").alias("definition")
    )
    listed = meet(tables, index_list, TABLE).select(
        *TABLE,
        F.col("name").alias("index_name"),
        (F.coalesce(_number("unique"), F.lit(0)) != 0).alias("is_unique"),
    )
    on = ["db_id", "index_name"]
    return meet(meet(listed, members, on, "left"), texts, on, "left").select(
        *TABLE,
        "index_name",
        "is_unique",
        F.coalesce("_m.name", F.array().cast("array<string>")).alias("columns"),
        "definition",
    )


def sqlite_trigger_rows(tables: DataFrame, master: DataFrame) -> DataFrame:
    sql = F.col("sql")
    found = master.where(F.col("type") == "trigger").select(
        "db_id",
        F.col("tbl_name").alias("table_name"),
        F.col("name").alias("trigger_name"),
        ddl.trigger_timing(sql).alias("timing"),
        ddl.trigger_events(sql).alias("events"),
        sql.alias("definition"),
    )
    return meet(found, tables, TABLE, "left_semi")


# -- Folds ------------------------------------------------------------------------------


def fold_keys(keys: DataFrame) -> DataFrame:
    """Primary-key columns per table in key order."""
    members = F.sort_array(F.collect_list(F.struct("key_pos", "column_name")))
    return keys.groupBy(*TABLE).agg(members.alias("_k")).select(
        *TABLE, F.col("_k.column_name").alias("primary_key")
    )


def fold_foreign(foreign: DataFrame) -> DataFrame:
    """One row per foreign key with both column lists; actions come from its first row."""
    part = F.struct(
        "position",
        "column_name",
        "references_column",
        "references_table",
        "on_delete",
        "on_update",
        "name",
    )
    parts = foreign.groupBy(*TABLE, "fk_key").agg(F.sort_array(F.collect_list(part)).alias("_p"))
    first = F.element_at("_p", 1)
    return parts.select(
        *TABLE,
        "fk_key",
        first["name"].alias("name"),
        F.col("_p.column_name").alias("columns"),
        first["references_table"].alias("references_table"),
        F.filter("_p.references_column", lambda c: c.isNotNull()).alias("references_columns"),
        first["on_delete"].alias("on_delete"),
        first["on_update"].alias("on_update"),
    )


def fold_enums(labels: DataFrame) -> DataFrame:
    """Labels per enum in declared order."""
    members = F.sort_array(F.collect_list(F.struct("label_order", "label")))
    return labels.groupBy("db_id", "enum_name").agg(members.alias("_l")).select(
        "db_id", "enum_name", F.col("_l.label").alias("labels")
    )


def _listed(name: str) -> Column:
    """A table's rows of one kind in order; rows of other kinds are null here."""
    return F.sort_array(F.collect_list(name)).alias(name)


def _keys_of(parts: Column) -> Column:
    """Foreign-key columns, sorted by key and position, as one struct per key."""
    def key(k: Column) -> Column:
        own = F.filter(parts, lambda p: p["fk_key"].eqNullSafe(k))
        first = F.get(own, F.lit(0))
        return F.struct(
            first["name"].alias("name"),
            F.transform(own, lambda p: p["column_name"]).alias("columns"),
            first["references_table"].alias("references_table"),
            F.filter(F.transform(own, lambda p: p["references_column"]), lambda c: c.isNotNull()).alias("references_columns"),
            first["on_delete"].alias("on_delete"),
            first["on_update"].alias("on_update"),
        )

    return F.transform(F.array_distinct(F.transform(parts, lambda p: p["fk_key"])), key)


def schema_report(
    columns: DataFrame,
    keys: DataFrame,
    foreign: DataFrame,
    indexes: DataFrame,
    triggers: DataFrame,
    ledger_table: str,
    table: str | None = None,
) -> DataFrame:
    """One row per table with its columns, primary key, foreign keys, indexes, triggers.

    The ledger table is left out; ``table`` keeps one table (none, if it is unknown).
    The rows of all kinds meet in one shuffle and are sorted apart inside each table.
    """
    wanted = F.col("table_name") != ledger_table
    if table is not None:
        wanted = wanted & (F.col("table_name") == table)

    def rows(df: DataFrame, kind: str, order: list[str], fields: list[str]) -> DataFrame:
        return df.where(wanted).select(*TABLE, F.struct(*order, *[f for f in fields if f not in order]).alias(kind))

    parts = [
        rows(columns, "columns", ["position"], ["column_name", "data_type", "nullable", "default"]),
        rows(keys, "keys", ["key_pos"], ["column_name"]),
        rows(foreign, "foreign", ["fk_key", "position"], ["column_name", "references_column", "references_table", "on_delete", "on_update", "name"]),
        rows(indexes, "indexes", ["index_name"], ["is_unique", "columns", "definition"]),
        rows(triggers, "triggers", ["trigger_name"], ["timing", "events", "definition"]),
    ]
    kinds = ["columns", "keys", "foreign", "indexes", "triggers"]
    all_rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    grouped = all_rows.groupBy(*TABLE).agg(*map(_listed, kinds)).where(F.size("columns") > 0)
    columns_shown = ["column_name", "data_type", "nullable", "default", "position"]
    return grouped.select(
        *TABLE,
        F.transform("columns", lambda c: F.struct(*[c[f].alias(f) for f in columns_shown])).alias("columns"),
        F.transform("keys", lambda k: k["column_name"]).alias("primary_key"),
        _keys_of(F.col("foreign")).alias("foreign_keys"),
        "indexes",
        "triggers",
    )


# -- Comparison -------------------------------------------------------------------------


def schema_objects(
    columns: DataFrame, keys: DataFrame, foreign: DataFrame, indexes: DataFrame, triggers: DataFrame
) -> DataFrame:
    """Everything a table consists of, one row each: kind, object_name, definition.

    A foreign key without a name goes by what it connects, never by its number: adding one
    in front renumbers the others.
    """
    def rows(df: DataFrame, kind: str, name: str, *parts: Column) -> DataFrame:
        texts = [F.coalesce(p.cast("string"), F.lit("-")) for p in parts]
        return df.select(
            *TABLE,
            F.lit(kind).alias("kind"),
            F.col(name).cast("string").alias("object_name"),
            F.concat_ws(" ", *texts).alias("definition"),
        )

    def listed(name: str) -> Column:
        return F.array_join(name, ",")

    named_keys = fold_keys(keys).withColumn("_name", F.lit("primary key"))
    by_content = F.concat(listed("columns"), F.lit(" -> "), F.col("references_table"))
    folded = fold_foreign(foreign).withColumn("_name", F.coalesce("name", by_content))
    return (
        rows(columns, "column", "column_name", F.col("data_type"), F.col("nullable"), F.col("default"))
        .unionByName(rows(named_keys, "primary_key", "_name", listed("primary_key")))
        .unionByName(
            rows(
                folded, "foreign_key", "_name",
                listed("columns"), F.col("references_table"), listed("references_columns"),
                F.col("on_delete"), F.col("on_update"),
            )
        )
        .unionByName(rows(indexes, "index", "index_name", F.col("definition")))
        .unionByName(
            rows(triggers, "trigger", "trigger_name", F.col("timing"), listed("events"), F.col("definition"))
        )
    )


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change added, removed or altered; shows what a recreated table lost.

    Both sides meet in one shuffle, where equal rows are counted; only objects with a row that one
    side has more often are listed, as most of a fleet stays as it is. Objects of one name on one
    side, as unnamed keys over the same columns may be, are compared as the sorted list of their
    definitions.
    """
    key = [*TABLE, "kind", "object_name"]
    own = F.coalesce("definition", F.lit("-")).alias("definition")
    sides = before.select(*key, F.lit(False).alias("later"), own).unionByName(
        after.select(*key, F.lit(True).alias("later"), own)
    )
    # The key's hash, as keys may hold nulls and a join would not match those.
    met = sides.withColumn("_object", F.xxhash64(*key)).repartition("_object")
    more = F.sum(F.when(F.col("later"), 1).otherwise(-1))
    differing = met.groupBy("_object", *key, "definition").agg(more.alias("_more")).where("_more <> 0")
    objects = differing.select("_object").distinct()
    changed = met.join(objects.hint("shuffle_hash"), "_object")

    def text(later: bool) -> Column:
        own = F.when(F.col("later") == later, F.col("definition"))
        return F.nullif(F.array_join(F.sort_array(F.collect_list(own)), "; "), F.lit(""))

    state = F.when(F.col("before").isNull(), "added").when(
        F.col("after").isNull(), "removed"
    ).otherwise("changed")
    return (
        changed.groupBy("_object", *key)
        .agg(text(False).alias("before"), text(True).alias("after"))
        .where(~F.col("before").eqNullSafe(F.col("after")))
        .select(*key, state.alias("state"), "before", "after")
    )


def renamed(diff: DataFrame, percent: int = 50) -> DataFrame:
    """Removed and added objects that look like one object under another name:
    db_id, table_name, kind, old_name, new_name, before, after, percent_shared.

    Definitions are compared as sets of words, the object's own name left out; two objects
    belong together if each is the other's best match (ties: the least name) and they share
    at least ``percent`` of their words. Only objects of one table and kind are compared.
    """
    on = [*TABLE, "kind"]

    def side(state: str, text: str, name: str) -> DataFrame:
        words = F.array_distinct(F.split(F.replace(F.col(text), F.col("object_name"), F.lit("")), r"[\s,()]+"))
        rows = diff.where(F.col("state") == state)
        return rows.select(*on, F.col("object_name").alias(name), text, F.array_remove(words, "").alias(f"_{text}"))

    both = side("removed", "before", "old_name").join(side("added", "after", "new_name"), on)
    union = F.greatest(F.size(F.array_union("_before", "_after")), F.lit(1))
    shared = F.floor(F.lit(100) * F.size(F.array_intersect("_before", "_after")) / union)
    scored = both.withColumn("percent_shared", shared).where(F.col("percent_shared") >= percent)

    def rank(mine: str, other: str) -> Column:
        return F.row_number().over(Window.partitionBy(*on, mine).orderBy(F.desc("percent_shared"), other))

    ranked = scored.withColumns({"_a": rank("old_name", "new_name"), "_b": rank("new_name", "old_name")})
    return ranked.where("_a = 1 AND _b = 1").select(*on, "old_name", "new_name", "before", "after", "percent_shared")


def fingerprints(columns: DataFrame) -> DataFrame:
    """Per table a hash over its columns in order."""
    part = F.struct("position", "column_name", "data_type", "nullable", "default")
    text = F.to_json(F.sort_array(F.collect_list(part)))
    return columns.groupBy(*TABLE).agg(F.sha2(text, 256).alias("fingerprint"))


def fleet_schema_drift(columns: DataFrame) -> DataFrame:
    """Tables that differ from the form most databases have; ties go to the higher hash.

    Votes are counted before they meet; the winners are attached, as a table name may be
    shared by most of the fleet.
    """
    prints = fingerprints(columns)
    votes = prints.groupBy("table_name", "fingerprint").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("fingerprint", "n"), F.struct("n", "fingerprint"))
    winners = votes.groupBy("table_name").agg(best.alias("_b"), F.count("*").alias("forms")).select(
        "table_name", F.col("_b.fingerprint").alias("usual"), F.col("_b.n").alias("votes"), "forms"
    )
    return attach(prints, winners, ["table_name"], how="inner").where(
        F.col("fingerprint") != F.col("usual")
    )
