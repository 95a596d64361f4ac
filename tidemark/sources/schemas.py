"""Explicit schemas of everything read from files."""

from __future__ import annotations

LEDGER = "db_id string, name string, checksum string, applied_at timestamp_ntz"
JOURNAL = (
    "version string, dialect string, entries array<struct<idx: bigint, version: string, "
    "`when`: bigint, tag: string, breakpoints: boolean>>"
)
FOREIGN_LEDGER = "db_id string, hash string, created_at string"
ATTEMPTS = (
    "db_id string, replica bigint, name string, checksum string, ok boolean, kind string, "
    "code string, message string, attempted_at timestamp_ntz, ended_at timestamp_ntz"
)

# Catalogue rows; numbers may arrive as text, so they are read as text.
PG_COLUMNS = (
    "db_id string, table_schema string, table_name string, column_name string, "
    "data_type string, udt_name string, is_nullable string, column_default string, "
    "ordinal_position string"
)
PG_TABLES = "db_id string, table_schema string, table_name string, table_type string"
PG_TABLE_CONSTRAINTS = (
    "db_id string, table_schema string, table_name string, constraint_schema string, "
    "constraint_name string, constraint_type string"
)
PG_KEY_COLUMN_USAGE = (
    "db_id string, constraint_schema string, constraint_name string, column_name string, "
    "ordinal_position string"
)
PG_CONSTRAINT = (
    "db_id string, conname string, contype string, conrelid bigint, confrelid bigint, "
    "conkey array<int>, confkey array<int>, confdeltype string, confupdtype string"
)
PG_CLASS = "db_id string, oid bigint, relname string, relnamespace bigint"
PG_NAMESPACE = "db_id string, oid bigint, nspname string"
PG_ATTRIBUTE = "db_id string, attrelid bigint, attnum int, attname string"
PG_TYPE = "db_id string, oid bigint, typname string, typnamespace bigint"
PG_ENUM = "db_id string, enumtypid bigint, enumsortorder double, enumlabel string"
PG_INDEXES = (
    "db_id string, schemaname string, tablename string, indexname string, indexdef string"
)
PG_TRIGGERS = (
    "db_id string, trigger_schema string, event_object_table string, trigger_name string, "
    "action_timing string, event_manipulation string, action_statement string"
)
SQLITE_MASTER = "db_id string, type string, name string, tbl_name string, sql string"
SQLITE_COLUMNS = (
    "db_id string, table_name string, cid string, name string, type string, "
    "`notnull` string, dflt_value string, pk string"
)
SQLITE_FOREIGN_KEYS = (
    "db_id string, table_name string, id string, seq string, `table` string, "
    "`from` string, `to` string, on_update string, on_delete string"
)
SQLITE_INDEX_LIST = (
    "db_id string, table_name string, name string, `unique` string, origin string"
)
SQLITE_INDEX_INFO = "db_id string, index_name string, seqno string, name string"
DATABASES = "db_id string, driver string"
