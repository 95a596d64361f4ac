"""Catalogue listings, schema reports, contracts and fleet comparison."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import functions as F

from tidemark.functions import types
from tidemark.operators import catalog as cat, contracts
from tidemark.plans import calls
from tidemark.session import fresh_dir
from tidemark.sources import catalog as rows_of
from workload.registry import duck, query, with_

LEDGER = calls.LEDGER_TABLE

_PG = [
    "pg_columns", "pg_tables", "pg_table_constraints", "pg_key_column_usage", "pg_constraint",
    "pg_class", "pg_namespace", "pg_attribute", "pg_type", "pg_enum", "pg_indexes", "pg_triggers",
]
_LITE = ["sqlite_master", "sqlite_columns", "sqlite_foreign_keys", "sqlite_index_list", "sqlite_index_info"]

# Each text below says what a listing means: first what is visible, then lookups per key.
COLUMNS = """
  SELECT db_id, table_name, column_name, data_type, udt_name, is_nullable = 'YES' AS nullable,
    column_default AS dflt, coalesce(try_cast(ordinal_position AS BIGINT), 0) AS position
  FROM pg_columns SEMI JOIN (
    SELECT db_id, table_schema, table_name FROM pg_tables WHERE table_type = 'BASE TABLE' AND table_schema = 'public') base
  USING (db_id, table_schema, table_name)"""
KEYS = """
  WITH owner AS (
    SELECT db_id, constraint_schema, constraint_name, max(table_name) AS table_name FROM pg_table_constraints
    WHERE constraint_type = 'PRIMARY KEY' AND table_schema = 'public' GROUP BY ALL)
  SELECT db_id, table_name, column_name, try_cast(ordinal_position AS BIGINT) AS key_pos
  FROM pg_key_column_usage JOIN owner USING (db_id, constraint_schema, constraint_name)"""
_ACTIONS = "MAP {'a': 'NO ACTION', 'r': 'RESTRICT', 'c': 'CASCADE', 'n': 'SET NULL', 'd': 'SET DEFAULT'}"
FOREIGN = f"""
  WITH named AS (
    SELECT db_id, attrelid AS oid, map_from_entries(list((attnum, attname))) AS names FROM pg_attribute GROUP BY ALL),
  known AS (
    SELECT db_id, oid, relname, names, relnamespace IN (
      SELECT oid FROM pg_namespace WHERE nspname = 'public' AND pg_namespace.db_id = pg_class.db_id) AS visible
    FROM pg_class JOIN named USING (db_id, oid)),
  pairs AS (
    SELECT *, unnest(list_zip(conkey, confkey, range(1, len(conkey) + 1))) AS pair FROM pg_constraint WHERE contype = 'f')
  SELECT db_id, child.relname AS table_name, conname AS name, child.names[pair[1]] AS column_name,
    parent.relname AS references_table, parent.names[pair[2]] AS references_column, pair[3] AS position,
    {_ACTIONS}[confdeltype] AS on_delete, {_ACTIONS}[confupdtype] AS on_update
  FROM pairs JOIN (SELECT db_id, oid AS conrelid, relname, names FROM known WHERE visible) child USING (db_id, conrelid)
  JOIN (SELECT db_id, oid AS confrelid, relname, names FROM known) parent USING (db_id, confrelid)"""
ENUMS = """
  WITH spaces AS (SELECT db_id, oid AS typnamespace FROM pg_namespace WHERE nspname = 'public'),
  shown AS (SELECT db_id, oid AS enumtypid, typname FROM pg_type SEMI JOIN spaces USING (db_id, typnamespace))
  SELECT db_id, typname AS enum_name, enumlabel AS label, enumsortorder AS label_order
  FROM pg_enum JOIN shown USING (db_id, enumtypid)"""
INDEX_COLUMNS = r"""CASE WHEN list_bool_and(list_transform(parts, lambda p: regexp_full_match(p, '\S+(\s+(ASC|DESC|NULLS|FIRST|LAST))*')))
  THEN array_to_string(list_transform(parts, lambda p: trim(regexp_extract(p, '^\S+'), '"')), ',') ELSE '' END"""
INDEXES = rf"""
  SELECT db_id, tablename AS table_name, indexname AS index_name, starts_with(indexdef, 'CREATE UNIQUE INDEX') AS is_unique,
    {INDEX_COLUMNS} AS columns, indexdef AS definition
  FROM (SELECT *, list_transform(string_split(regexp_extract(indexdef, '^[^(]*\(([^()]*)\)', 1), ','), lambda p: trim(p)) AS parts
    FROM pg_indexes WHERE schemaname = 'public') i"""
TRIGGERS = """
  SELECT db_id, event_object_table AS table_name, trigger_name, min(action_timing) AS timing,
    string_agg(event_manipulation, ',' ORDER BY event_manipulation) AS events, min(action_statement) AS definition
  FROM pg_triggers WHERE trigger_schema = 'public' GROUP BY 1, 2, 3"""


def _pg(tail: str, **more: str) -> str:
    base = {n: duck(n) for n in _PG}
    return with_(
        tail, **base, cols=COLUMNS, pks=KEYS, fks=FOREIGN, enums=ENUMS, idx=INDEXES, trg=TRIGGERS, **more
    )


class Pg:
    """The flat Postgres shapes of the derived fleet."""

    def __init__(self, s):
        self.s = s

    @cached_property
    def columns(self):
        return cat.pg_columns(self.s.pg_columns(), self.s.pg_tables())

    @cached_property
    def keys(self):
        return cat.pg_keys(self.s.pg_table_constraints(), self.s.pg_key_column_usage())

    @cached_property
    def foreign(self):
        s = self.s
        return cat.pg_foreign(s.pg_constraint(), s.pg_class(), s.pg_namespace(), s.pg_attribute())

    @cached_property
    def enums(self):
        return cat.pg_enum_labels(self.s.pg_type(), self.s.pg_enum(), self.s.pg_namespace())

    @cached_property
    def indexes(self):
        return cat.pg_index_rows(self.s.pg_indexes())

    @cached_property
    def triggers(self):
        return cat.pg_trigger_rows(self.s.pg_triggers())


def _joined(name: str, alias: str | None = None):
    return F.array_join(name, ",").alias(alias or name)


# Listings -------------------------------------------------------------------------------


@query("catalog_columns", _pg("SELECT db_id, table_name, column_name, data_type, udt_name, nullable, dflt, position FROM cols"))
def catalog_columns(s):
    return Pg(s).columns.withColumnRenamed("default", "dflt")


@query(
    "catalog_pks",
    _pg("SELECT db_id, table_name, string_agg(column_name, ',' ORDER BY key_pos) AS primary_key FROM pks GROUP BY 1, 2"),
)
def catalog_pks(s):
    return cat.fold_keys(Pg(s).keys).select("db_id", "table_name", _joined("primary_key"))


@query(
    "catalog_fks",
    _pg("""
    SELECT db_id, table_name, name, string_agg(column_name, ',' ORDER BY position) AS columns, min(references_table) AS references_table,
      string_agg(references_column, ',' ORDER BY position) AS references_columns, min(on_delete) AS on_delete, min(on_update) AS on_update
    FROM fks GROUP BY 1, 2, 3"""),
)
def catalog_fks(s):
    return cat.fold_foreign(Pg(s).foreign).select(
        "db_id", "table_name", "name", _joined("columns"), "references_table",
        _joined("references_columns"), "on_delete", "on_update",
    )


@query(
    "catalog_enums",
    _pg("SELECT db_id, enum_name, string_agg(label, ',' ORDER BY label_order) AS labels FROM enums GROUP BY 1, 2"),
)
def catalog_enums(s):
    return cat.fold_enums(Pg(s).enums).select("db_id", "enum_name", _joined("labels"))


@query("catalog_triggers", _pg("SELECT * FROM trg"))
def catalog_triggers(s):
    return Pg(s).triggers.withColumn("events", F.array_join("events", ","))


@query("index_columns", _pg("SELECT * FROM idx"))
def index_columns(s):
    return Pg(s).indexes.withColumn("columns", F.array_join("columns", ","))


@query(
    "catalog_rows",
    with_(
        "SELECT 'columns' AS kind, db_id, table_name, column_name AS name, ordinal_position AS place FROM pg_columns "
        "UNION ALL SELECT 'triggers', db_id, event_object_table, trigger_name, event_manipulation FROM pg_triggers",
        pg_columns=duck("pg_columns"),
        pg_triggers=duck("pg_triggers"),
    ),
)
def catalog_rows(s):
    """Collected rows of two kinds, written as JSON lines and read with their schemas."""
    root = fresh_dir(s.spark, "catalogues")
    s.pg_columns().write.json(f"{root}/columns")
    s.pg_triggers().write.json(f"{root}/triggers")
    columns, triggers = (rows_of.read_rows(s.spark, root, kind) for kind in ("columns", "triggers"))
    return columns.select(F.lit("columns").alias("kind"), "db_id", "table_name", F.col("column_name").alias("name"), F.col("ordinal_position").alias("place")).unionByName(
        triggers.select(
            F.lit("triggers").alias("kind"), "db_id", F.col("event_object_table").alias("table_name"),
            F.col("trigger_name").alias("name"), F.col("event_manipulation").alias("place"),
        )
    )


# SQLite ---------------------------------------------------------------------------------

LITE_TABLES = "SELECT db_id, name AS table_name FROM sqlite_master WHERE type = 'table' AND NOT name ILIKE 'sqlite_%'"
_DECL = "upper(coalesce(data_type, ''))"
LITE_WIRE = f"""CASE WHEN contains({_DECL}, 'INT') THEN 'number'
  WHEN regexp_matches({_DECL}, 'CHAR|CLOB|TEXT|BLOB') OR {_DECL} = '' THEN 'string'
  WHEN regexp_matches({_DECL}, 'REAL|FLOA|DOUB|NUMERIC|DECIMAL') THEN 'number' WHEN contains({_DECL}, 'BOOL') THEN 'boolean'
  WHEN regexp_matches({_DECL}, 'DATE|TIME') THEN 'string' ELSE 'unknown' END"""
LITE_COLUMNS = """
  SELECT c.db_id, c.table_name, c.name AS column_name, coalesce(c.type, '') AS data_type,
    CAST(c.`notnull` AS BIGINT) = 0 AND CAST(c.pk AS BIGINT) = 0 AS nullable, c.dflt_value AS dflt, coalesce(try_cast(c.cid AS BIGINT) + 1, 0) AS position
  FROM sqlite_columns c JOIN lite_tables t ON t.db_id = c.db_id AND t.table_name = c.table_name"""
_HEADER = "string_split(upper(sql), ' ON ')[1]"
LITE_TRIGGERS = f"""
  SELECT m.db_id, m.tbl_name AS table_name, m.name AS trigger_name,
    CASE WHEN contains({_HEADER}, 'INSTEAD OF') THEN 'INSTEAD OF' WHEN contains({_HEADER}, 'BEFORE') THEN 'BEFORE' ELSE 'AFTER' END AS timing,
    array_to_string(list_filter(['DELETE', 'INSERT', 'UPDATE'], lambda e: contains({_HEADER}, e)), ',') AS events, sql AS definition
  FROM sqlite_master m JOIN lite_tables t ON t.db_id = m.db_id AND t.table_name = m.tbl_name WHERE m.type = 'trigger'"""
LITE_INDEXES = """
  SELECT l.db_id, l.table_name, l.name AS index_name, l.`unique` <> '0' AS is_unique, coalesce(i.columns, '') AS columns, m.sql AS definition
  FROM sqlite_index_list l JOIN lite_tables t ON t.db_id = l.db_id AND t.table_name = l.table_name
  LEFT JOIN (SELECT db_id, index_name, string_agg(name, ',' ORDER BY CAST(seqno AS BIGINT)) AS columns
    FROM sqlite_index_info WHERE name IS NOT NULL GROUP BY 1, 2) i ON i.db_id = l.db_id AND i.index_name = l.name
  LEFT JOIN sqlite_master m ON m.db_id = l.db_id AND m.name = l.name AND m.type = 'index'"""


def _lite(tail: str) -> str:
    return with_(
        tail, **{n: duck(n) for n in _LITE}, lite_tables=LITE_TABLES, cols=LITE_COLUMNS, trg=LITE_TRIGGERS, idx=LITE_INDEXES
    )


class Lite:
    """The flat SQLite shapes of the derived fleet."""

    def __init__(self, s):
        self.s, self.tables = s, cat.sqlite_tables(s.sqlite_master())

    @cached_property
    def columns(self):
        return cat.sqlite_columns(self.tables, self.s.sqlite_columns())

    @cached_property
    def keys(self):
        return cat.sqlite_keys(self.tables, self.s.sqlite_columns())

    @cached_property
    def foreign(self):
        return cat.sqlite_foreign(self.tables, self.s.sqlite_foreign_keys())

    @cached_property
    def indexes(self):
        s = self.s
        return cat.sqlite_index_rows(
            self.tables, s.sqlite_index_list(), s.sqlite_index_info(), s.sqlite_master()
        )

    @cached_property
    def triggers(self):
        return cat.sqlite_trigger_rows(self.tables, self.s.sqlite_master())


@query("trigger_header", _lite("SELECT * FROM trg"))
def trigger_header(s):
    return Lite(s).triggers.withColumn("events", F.array_join("events", ","))


@query(
    "sqlite_type_map",
    _lite(f"SELECT db_id, table_name, column_name, data_type, {LITE_WIRE} AS wire_type, nullable FROM cols"),
)
def sqlite_type_map(s):
    typed = contracts.sqlite_contract_columns(Lite(s).columns)
    return typed.select("db_id", "table_name", "column_name", "data_type", "wire_type", "nullable")


@query(
    "sqlite_catalog",
    _lite("""
    SELECT t.db_id, t.table_name, coalesce(c.x, '') AS columns, coalesce(k.x, '') AS primary_key, coalesce(f.x, '') AS foreign_keys,
      coalesce(i.x, '') AS indexes, coalesce(g.x, '') AS triggers
    FROM (SELECT DISTINCT db_id, table_name FROM cols WHERE table_name <> 'schema_ledger') t
    LEFT JOIN (SELECT db_id, table_name, string_agg(column_name || ' ' || data_type || ' ' || nullable || ' ' || coalesce(dflt, '-') || ' ' || position, ';' ORDER BY position, column_name) AS x FROM cols GROUP BY 1, 2) c ON c.db_id = t.db_id AND c.table_name = t.table_name
    LEFT JOIN (SELECT db_id, table_name, string_agg(name, ',' ORDER BY CAST(pk AS BIGINT)) AS x FROM sqlite_columns WHERE pk <> '0' GROUP BY 1, 2) k ON k.db_id = t.db_id AND k.table_name = t.table_name
    LEFT JOIN (SELECT db_id, table_name, string_agg(x, ';' ORDER BY id) AS x FROM (SELECT db_id, table_name, id,
        '- ' || string_agg(`from`, ',' ORDER BY seq) || ' ' || min(`table`) || ' ' || coalesce(string_agg(`to`, ',' ORDER BY seq), '') || ' ' || min(on_delete) || ' ' || min(on_update) AS x
      FROM sqlite_foreign_keys GROUP BY 1, 2, 3) q GROUP BY 1, 2) f ON f.db_id = t.db_id AND f.table_name = t.table_name
    LEFT JOIN (SELECT db_id, table_name, string_agg(index_name || ' ' || is_unique || ' ' || columns || ' ' || coalesce(definition, '-'), ';' ORDER BY index_name) AS x FROM idx GROUP BY 1, 2) i ON i.db_id = t.db_id AND i.table_name = t.table_name
    LEFT JOIN (SELECT db_id, table_name, string_agg(trigger_name || ' ' || timing || ' ' || events || ' ' || definition, ';' ORDER BY trigger_name) AS x FROM trg GROUP BY 1, 2) g ON g.db_id = t.db_id AND g.table_name = t.table_name"""),
)
def sqlite_catalog(s):
    x = Lite(s)
    return report_text(calls.schema(x.columns, x.keys, x.foreign, x.indexes, x.triggers)["tables"])


def report_text(report):
    """The nested report with every list written out, as both engines print it."""
    def text(name, fn):
        return F.array_join(F.transform(name, fn), ";").alias(name)

    def words(*parts):
        return F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])

    return report.select(
        "db_id",
        "table_name",
        text("columns", lambda c: words(c["column_name"], c["data_type"], c["nullable"], c["default"], c["position"])),
        _joined("primary_key"),
        text(
            "foreign_keys",
            lambda k: words(
                k["name"], F.array_join(k["columns"], ","), k["references_table"],
                F.array_join(k["references_columns"], ","), k["on_delete"], k["on_update"],
            ),
        ),
        text("indexes", lambda i: words(i["index_name"], i["is_unique"], F.array_join(i["columns"], ","), i["definition"])),
        text("triggers", lambda g: words(g["trigger_name"], g["timing"], F.array_join(g["events"], ","), g["definition"])),
    )


# Reports, contracts, comparison ---------------------------------------------------------


@query(
    "schema_report",
    _pg("""
    SELECT t.db_id, t.table_name, t.x AS columns, coalesce(k.x, '') AS primary_key, coalesce(f.x, '') AS foreign_keys,
      coalesce(i.x, '') AS indexes, coalesce(g.x, '') AS triggers
    FROM (SELECT db_id, table_name, string_agg(column_name || ' ' || data_type || ' ' || nullable || ' ' || coalesce(dflt, '-') || ' ' || position, ';' ORDER BY position) AS x FROM cols WHERE table_name <> 'schema_ledger' GROUP BY 1, 2) t
    LEFT JOIN (SELECT db_id, table_name, string_agg(column_name, ',' ORDER BY key_pos) AS x FROM pks GROUP BY 1, 2) k ON k.db_id = t.db_id AND k.table_name = t.table_name
    LEFT JOIN (SELECT db_id, table_name, string_agg(x, ';' ORDER BY name) AS x FROM (SELECT db_id, table_name, name,
        name || ' ' || string_agg(column_name, ',' ORDER BY position) || ' ' || min(references_table) || ' ' || string_agg(references_column, ',' ORDER BY position) || ' ' || min(on_delete) || ' ' || min(on_update) AS x
      FROM fks GROUP BY 1, 2, 3) q GROUP BY 1, 2) f ON f.db_id = t.db_id AND f.table_name = t.table_name
    LEFT JOIN (SELECT db_id, table_name, string_agg(index_name || ' ' || is_unique || ' ' || columns || ' ' || definition, ';' ORDER BY index_name) AS x FROM idx GROUP BY 1, 2) i ON i.db_id = t.db_id AND i.table_name = t.table_name
    LEFT JOIN (SELECT db_id, table_name, string_agg(trigger_name || ' ' || timing || ' ' || events || ' ' || definition, ';' ORDER BY trigger_name) AS x FROM trg GROUP BY 1, 2) g ON g.db_id = t.db_id AND g.table_name = t.table_name"""),
)
def schema_report(s):
    x = Pg(s)
    return report_text(calls.schema(x.columns, x.keys, x.foreign, x.indexes, x.triggers)["tables"])


_ELEMENT = "CASE WHEN data_type = 'ARRAY' THEN regexp_replace(udt_name, '^_', '') ELSE udt_name END"
_PASCAL = "array_to_string(list_transform(list_filter(string_split_regex({0}, '[_ -]'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '')"
_NUMBER, _STRING = types.PG_WIRE["number"], types.PG_WIRE["string"]
WIRE = f"""
  SELECT *, CASE WHEN data_type = 'ARRAY' THEN base || '[]' ELSE base END AS wire_type
  FROM (SELECT c.*, CASE WHEN element IN {_NUMBER} THEN 'number' WHEN element IN {_STRING} THEN 'string'
      WHEN element = 'bool' THEN 'boolean' WHEN element IN ('json', 'jsonb') THEN 'Json'
      WHEN EXISTS (SELECT 1 FROM enums e WHERE e.db_id = c.db_id AND e.enum_name = c.element) THEN {_PASCAL.format('element')} ELSE 'unknown' END AS base
    FROM (SELECT *, {_ELEMENT} AS element FROM cols) c) b"""


@query("pg_type_map", _pg("SELECT db_id, table_name, column_name, wire_type, nullable FROM wire", wire=WIRE))
def pg_type_map(s):
    x = Pg(s)
    typed = contracts.pg_contract_columns(x.columns, x.enums)
    return typed.select("db_id", "table_name", "column_name", "wire_type", "nullable")


_PROPERTY = "CASE WHEN regexp_full_match({0}, '[A-Za-z_$][A-Za-z0-9_$]*') THEN {0} ELSE '''' || replace({0}, '''', '\\''') || '''' END"
_DECLARED = f"""
  SELECT db_id, 'table' AS kind, table_name AS name, 'export interface ' || {_PASCAL.format('table_name')} || ' {{' || chr(10) ||
    string_agg('  ' || {_PROPERTY.format('column_name')} || ': ' || wire_type || CASE WHEN nullable THEN ' | null' ELSE '' END || ';' || chr(10), '' ORDER BY position) || '}}' AS text
  FROM wire WHERE table_name <> '{LEDGER}' GROUP BY db_id, table_name
  UNION ALL SELECT DISTINCT db_id, 'member', table_name, '  ' || {_PROPERTY.format('table_name')} || ': ' || {_PASCAL.format('table_name')} || ';'
  FROM wire WHERE table_name <> '{LEDGER}'
  UNION ALL SELECT DISTINCT db_id, 'alias', 'Json', '{contracts.JSON_ALIAS}' FROM wire WHERE table_name <> '{LEDGER}' AND wire_type IN ('Json', 'Json[]')
  UNION ALL SELECT db_id, 'enum', enum_name, 'export type ' || {_PASCAL.format('enum_name')} || ' = ' ||
    string_agg('''' || replace(label, '''', '\\''') || '''', ' | ' ORDER BY label_order) || ';' FROM enums GROUP BY db_id, enum_name"""


@query("contract_rows", _pg("SELECT * FROM declared", wire=WIRE, declared=_DECLARED))
def contract_rows(s):
    x = Pg(s)
    return calls.codegen(x.columns, x.enums)["rows"]


@query(
    "contract_counts",
    _pg(
        "SELECT db_id, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'enum') AS enums FROM declared GROUP BY db_id",
        wire=WIRE,
        declared=_DECLARED,
    ),
)
def contract_counts(s):
    x = Pg(s)
    return calls.codegen(x.columns, x.enums)["counts"]


_SHAPE = "string_agg(position || ' ' || column_name || ' ' || data_type || ' ' || nullable || ' ' || coalesce(dflt, '-'), ';' ORDER BY position)"


@query(
    "fleet_schema_drift",
    _pg(
        """
    SELECT p.db_id, p.table_name, w.votes, w.forms FROM shapes p JOIN (
      SELECT table_name, arg_max(shape, n) AS usual, max(n) AS votes, count(*) AS forms
      FROM (SELECT table_name, shape, count(*) AS n FROM shapes GROUP BY 1, 2) v GROUP BY 1) w ON p.table_name = w.table_name
    WHERE p.shape <> w.usual""",
        shapes=f"SELECT db_id, table_name, {_SHAPE} AS shape FROM cols GROUP BY 1, 2",
    ),
)
def fleet_schema_drift(s):
    return cat.fleet_schema_drift(Pg(s).columns).select("db_id", "table_name", "votes", "forms")


def _objects(prefix: str) -> str:
    """All objects of one state of the fleet, flat; keys without a name go by what they connect."""
    return f"""
  SELECT db_id, table_name, 'column' AS kind, column_name AS object_name, data_type || ' ' || nullable || ' ' || coalesce(dflt, '-') AS definition FROM {prefix}_cols
  UNION ALL SELECT db_id, table_name, 'primary_key', 'primary key', string_agg(column_name, ',' ORDER BY key_pos) FROM {prefix}_pks GROUP BY ALL
  UNION ALL SELECT db_id, table_name, 'foreign_key', coalesce(name, cols || ' -> ' || target), cols || ' ' || target || ' ' || refs || ' ' || on_delete || ' ' || coalesce(on_update, '-')
  FROM (SELECT db_id, table_name, fk_key, min(name) AS name, string_agg(column_name, ',' ORDER BY position) AS cols, min(references_table) AS target,
      string_agg(references_column, ',' ORDER BY position) AS refs, min(on_delete) AS on_delete, min(on_update) AS on_update FROM {prefix}_fks GROUP BY 1, 2, 3) folded
  UNION ALL SELECT db_id, table_name, 'index', index_name, coalesce(definition, '-') FROM {prefix}_idx
  UNION ALL SELECT db_id, table_name, 'trigger', trigger_name, timing || ' ' || events || ' ' || definition FROM {prefix}_trg"""


def _state(prefix: str, changed: bool, varied: list[str], **listings: str) -> dict[str, str]:
    """One state of the fleet: the tables that vary, the listings over them, all objects."""
    def over(sql: str) -> str:
        for old in varied:
            sql = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {prefix}_{old}", sql)
        return sql

    return {
        **{f"{prefix}_{old}": duck(old, changed) for old in varied},
        **{f"{prefix}_{name}": over(sql) for name, sql in listings.items()},
        prefix: _objects(prefix),
    }


_DIFF = """
    SELECT coalesce(b.db_id, a.db_id) AS db_id, coalesce(b.table_name, a.table_name) AS table_name, coalesce(b.kind, a.kind) AS kind,
      coalesce(b.object_name, a.object_name) AS object_name,
      CASE WHEN b.db_id IS NULL THEN 'added' WHEN a.db_id IS NULL THEN 'removed' ELSE 'changed' END AS state,
      b.definition AS before, a.definition AS after
    FROM before b FULL JOIN after a ON a.db_id = b.db_id AND a.table_name = b.table_name AND a.kind = b.kind AND a.object_name = b.object_name
    WHERE a.definition IS DISTINCT FROM b.definition"""
_PG_VARIED = ["pg_columns", "pg_key_column_usage", "pg_constraint", "pg_indexes", "pg_triggers"]
_PG_LISTS = {"cols": COLUMNS, "pks": KEYS, "fks": FOREIGN.replace("conname AS name,", "conname AS fk_key, conname AS name,"), "idx": INDEXES, "trg": TRIGGERS}


@query(
    "schema_diff",
    with_(
        _DIFF,
        **{n: duck(n) for n in _PG if n not in _PG_VARIED},
        **_state("before", False, _PG_VARIED, **_PG_LISTS),
        **_state("after", True, _PG_VARIED, **_PG_LISTS),
    ),
)
def schema_diff(s):
    def objects(changed: bool):
        return cat.schema_objects(
            cat.pg_columns(s.pg_columns(changed), s.pg_tables()),
            cat.pg_keys(s.pg_table_constraints(), s.pg_key_column_usage(changed)),
            cat.pg_foreign(s.pg_constraint(changed), s.pg_class(), s.pg_namespace(), s.pg_attribute()),
            cat.pg_index_rows(s.pg_indexes(changed)),
            cat.pg_trigger_rows(s.pg_triggers(changed)),
        )

    return cat.schema_diff(objects(False), objects(True))


_LITE_VARIED = ["sqlite_columns", "sqlite_foreign_keys", "sqlite_index_list"]
_LITE_LISTS = {
    "cols": LITE_COLUMNS,
    "pks": "SELECT db_id, table_name, name AS column_name, CAST(pk AS BIGINT) AS key_pos FROM sqlite_columns SEMI JOIN lite_tables USING (db_id, table_name) WHERE pk <> '0'",
    "fks": """SELECT db_id, table_name, CAST(id AS BIGINT) AS fk_key, CAST(NULL AS VARCHAR) AS name, CAST(seq AS BIGINT) AS position, `from` AS column_name,
      `table` AS references_table, `to` AS references_column, on_delete, on_update FROM sqlite_foreign_keys SEMI JOIN lite_tables USING (db_id, table_name)""",
    "idx": LITE_INDEXES,
    "trg": LITE_TRIGGERS,
}


@query(
    "sqlite_schema_diff",
    with_(
        _DIFF,
        **{n: duck(n) for n in _LITE if n not in _LITE_VARIED},
        lite_tables=LITE_TABLES,
        **_state("before", False, _LITE_VARIED, **_LITE_LISTS),
        **_state("after", True, _LITE_VARIED, **_LITE_LISTS),
    ),
)
def sqlite_schema_diff(s):
    """A table made anew with one more key in front: what it gained, and what it lost."""
    tables = cat.sqlite_tables(s.sqlite_master())

    def objects(changed: bool):
        columns = s.sqlite_columns(changed)
        return cat.schema_objects(
            cat.sqlite_columns(tables, columns),
            cat.sqlite_keys(tables, columns),
            cat.sqlite_foreign(tables, s.sqlite_foreign_keys(changed)),
            cat.sqlite_index_rows(tables, s.sqlite_index_list(changed), s.sqlite_index_info(), s.sqlite_master()),
            cat.sqlite_trigger_rows(tables, s.sqlite_master()),
        )

    return cat.schema_diff(objects(False), objects(True))
