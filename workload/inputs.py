"""The fleet data sets, derived from the given tables.

Each recipe is one SQL text that both engines run; a ``Dialect`` supplies the few
functions they spell differently.  Every recipe maps a whole table.  The remainders in
the recipes plant defects (a bad name, a changed hash, a lost column) in between the
sound rows; they do not thin the tables out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

NOW = "2024-01-01 00:05:00"
BASE = 1704067200  # 2024-01-01 00:00:00 UTC


class SparkDialect:
    def __init__(self, table: Callable[[str], str], dealt: Callable[[str], str] | None = None):
        self.table, self.dealt = table, dealt or table

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def moment(self, seconds: str) -> str:
        return f"(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}))"

    def stamp(self, seconds: str) -> str:
        return f"date_format({self.moment(seconds)}, 'yyyyMMddHHmmss')"

    def micros(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP))"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) div {b})"

    def binary(self, x: str) -> str:
        return f"encode({x}, 'UTF-8')"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def spread(self, source: str, columns: Sequence[str], rows: Sequence[Sequence]) -> str:
        """The rows as one JSON literal: far quicker to analyse than nested literals."""
        fields = ", ".join(f"{c} {_spark_type([r[i] for r in rows])}" for i, c in enumerate(columns))
        text = json.dumps([dict(zip(columns, row)) for row in rows])
        text = text.replace("\\", "\\\\").replace("'", "\\'")
        return (
            f"{source} LATERAL VIEW inline(from_json('{text}', 'array<struct<{fields}>>')) v "
            f"AS {', '.join(columns)}"
        )


class DuckDialect:
    def table(self, name: str) -> str:
        return name

    def dealt(self, name: str) -> str:
        return name

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def moment(self, seconds: str) -> str:
        return f"make_timestamp(CAST(({seconds}) * 1000000 AS BIGINT))"

    def stamp(self, seconds: str) -> str:
        return f"strftime({self.moment(seconds)}, '%Y%m%d%H%M%S')"

    def micros(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) // {b})"

    def binary(self, x: str) -> str:
        return x

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def spread(self, source: str, columns: Sequence[str], rows: Sequence[Sequence]) -> str:
        values = ", ".join(f"({', '.join(_literal(v, self) for v in row)})" for row in rows)
        return f"{source} CROSS JOIN (VALUES {values}) v({', '.join(columns)})"


DUCK = DuckDialect()


def _spark_type(values: Sequence) -> str:
    if any(isinstance(v, (list, tuple)) for v in values):
        return "array<int>"
    return "bigint" if all(isinstance(v, int) for v in values) else "string"


def _literal(v, d) -> str:
    if v is None:
        return "CAST(NULL AS STRING)"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return d.array(*[str(x) for x in v])
    return str(v)


# -- scripts and ledger -----------------------------------------------------------------


def _stems(d) -> str:
    return f"""
      SELECT *, {d.stamp(f"{BASE} + doc_id")} || '_' || lang || '_' || CAST(doc_id AS STRING) AS stem
      FROM {d.table('documents')}"""


def scripts(d) -> str:
    """Bad names occur in the databases with a two-digit number only."""
    text = "CASE WHEN doc_id % 2 = 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END"
    return f"""
    SELECT source AS db_id, doc_id,
      CASE CASE WHEN length(source) > 4 THEN doc_id % 23 END
        WHEN 1 THEN substr(stem, 2) || '.sql'
        WHEN 2 THEN replace(stem, '_', '-') || '.sql'
        WHEN 3 THEN substr(stem, 1, 15) || '.sql'
        WHEN 4 THEN stem || '.SQL'
        WHEN 5 THEN '20241399' || substr(stem, 9) || '.sql'
        WHEN 6 THEN stem || '!.sql'
        WHEN 7 THEN lang || CAST(doc_id AS STRING) || '.sql'
        ELSE stem || '.sql' END AS name,
      {d.binary(text)} AS content
    FROM ({_stems(d)}) s"""


def ledger(d) -> str:
    """Lost scripts and changed contents; some databases have no changed ones."""
    changed = "doc_id % 11 = 0 AND right(source, 1) NOT IN ('1', '2', '3')"
    return f"""
    SELECT source AS db_id,
      CASE WHEN doc_id % 17 = 0 THEN substr(stem, 1, 14) || '_gone_' || CAST(doc_id AS STRING) || '.sql'
        ELSE stem || '.sql' END AS name,
      CASE WHEN {changed} THEN {d.sha("text || 'x'")} ELSE {d.sha('text')} END AS checksum,
      {d.moment(f"{BASE} + 3600 + doc_id")} AS applied_at
    FROM ({_stems(d)}) s WHERE doc_id % 5 <> 0"""


def databases(d) -> str:
    return f"SELECT DISTINCT source AS db_id FROM {d.table('documents')}"


def readable(d) -> str:
    return f"""
    SELECT source AS db_id FROM {d.table('documents')}
    GROUP BY source HAVING max(doc_id) % 4 <> 1"""


def requested(d) -> str:
    """Baseline requests: twice for some scripts, and names that do not exist."""
    return f"""
    SELECT db_id, name FROM ({scripts(d)}) a WHERE doc_id % 3 <> 0
    UNION ALL SELECT db_id, name FROM ({scripts(d)}) b WHERE doc_id % 2 = 0
    UNION ALL SELECT db_id, 'no_such_' || name FROM ({scripts(d)}) c WHERE doc_id % 31 = 0"""


def name_requests(d) -> str:
    """Requests for new names: one per conversation turn."""
    return f"""
    SELECT 'src' || CAST(conv_id % 20 AS STRING) AS db_id, conv_id * 1000 + turn AS seq,
      {d.moment(f"{BASE} + conv_id % 400")} AS requested_at,
      CASE WHEN turn % 4 = 3 THEN role || ' ' || CAST(turn AS STRING)
        ELSE ' ' || role || '_' || CAST(length(text) AS STRING) || ' ' END AS slug
    FROM {d.table('conversations')}"""


# -- another tool's history -------------------------------------------------------------


def journal(d, dense: bool) -> str:
    """Entries of one journal per group of users.  Dense ones carry the day only, so
    almost every name has to move."""
    us = d.micros("ts")
    when = f"({us}) - ({us}) % 86400000000" if dense else us
    return f"""
    SELECT 'db' || CAST(user_id % 7 AS STRING) AS db_id, event_id AS idx, 0 AS pos,
      {d.div(when, 1000)} AS `when`,
      CAST(event_id AS STRING) || '_' || event_type
        || CASE WHEN event_id % 11 = 0 THEN ' é' ELSE '' END AS tag,
      {d.sha('props')} AS raw_hash
    FROM {d.table('events')}"""


def foreign_ledger(d) -> str:
    rows = f"""
      SELECT db_id, `when` AS created_at, idx,
        CASE WHEN idx % 13 = 0 THEN 'f' || substr(raw_hash, 2) ELSE raw_hash END AS hash
      FROM ({journal(d, dense=False)}) j WHERE idx % 4 <> 0"""
    return f"""
    SELECT db_id, CAST(created_at AS STRING) AS created_at, hash FROM ({rows}) a
    UNION ALL
    SELECT db_id, CAST(created_at AS STRING), 'zz' || substr(hash, 3) FROM ({rows}) b WHERE idx % 6 = 1
    UNION ALL
    SELECT db_id, 'not a number', CAST(NULL AS STRING) FROM ({rows}) c WHERE idx % 50 = 3"""


# -- attempts ---------------------------------------------------------------------------


def attempts(d) -> str:
    n = "event_id % 97"
    k = "substr(props, 7, length(props) - 7)"
    name = (
        f"'2024010100' || lpad(CAST({d.div(n, 60)} AS STRING), 2, '0') || "
        f"lpad(CAST(({n}) % 60 AS STRING), 2, '0') || '_step_' || CAST({n} AS STRING) || '.sql'"
    )
    body = (
        "'{\"code\":\"' || CASE WHEN event_id % 8 = 3 THEN 'UNKNOWN_DB' ELSE 'DRIVER_ERROR' END || "
        "'\",\"message\":\"statement refused\"' || "
        "CASE event_id % 4 WHEN 0 THEN ',\"driver\":\"postgres\",\"inner_code\":\"22P02\"' "
        "WHEN 1 THEN ',\"driver\":\"sqlite\",\"inner_code\":\"787\"' "
        "WHEN 2 THEN ',\"inner_code\":\"40P01\"' ELSE '' END || "
        f"',\"failed_index\":' || {k} || '}}'"
    )
    return f"""
    SELECT event_id, 'src' || CAST(user_id % 20 AS STRING) AS db_id, event_id % 3 AS replica,
      {name} AS name,
      CASE WHEN event_id % 7 = 0 THEN {d.sha(f"{name} || 'x'")} ELSE {d.sha(name)} END AS checksum,
      event_type <> 'error' AS ok,
      CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 10 = 0 THEN 'timeout'
        WHEN event_id % 10 = 1 THEN 'not_connected' WHEN event_id % 10 = 2 THEN 'other'
        ELSE 'remote' END AS kind,
      CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 10 = 3 THEN 'function_not_found'
        ELSE 'invocation_failed' END AS code,
      CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 10 = 4 THEN 'plain text ' || {k}
        WHEN event_id % 10 = 5 THEN 'handler error: {{"k": ' || {k} || '}}'
        ELSE 'handler error: ' || {body} END AS message,
      ts AS attempted_at, ts + INTERVAL '2' SECOND AS ended_at, CAST({k} AS BIGINT) AS k
    FROM {d.table('events')}"""


# -- catalogues -------------------------------------------------------------------------

# An observatory: instruments, what they saw through which filter, and who may use them when.
PG_COLUMN_ROWS = [
    ("public", "instrument", "code", "character", "bpchar", "NO", None, "1"),
    ("public", "instrument", "aperture_mm", "smallint", "int2", "NO", "200", "2"),
    ("public", "instrument", "first light", "timestamp without time zone", "timestamp", "YES", None, "3"),
    ("public", "instrument", "serial", "uuid", "uuid", "NO", "gen_random_uuid()", "4"),
    ("public", "instrument", "dome_address", "inet", "inet", "YES", None, "5"),
    ("public", "instrument", "2nd mirror", "boolean", "bool", "YES", "false", "6"),
    ("public", "instrument", "outline", "USER-DEFINED", "polyhedron", "YES", None, "7"),
    ("public", "exposure", "night", "date", "date", "NO", "CURRENT_DATE", "1"),
    ("public", "exposure", "frame_no", "integer", "int4", "NO", None, "2"),
    ("public", "exposure", "instrument_code", "character", "bpchar", "YES", None, "3"),
    ("public", "exposure", "seconds", "double precision", "float8", "NO", "30", "4"),
    ("public", "exposure", "band", "USER-DEFINED", "filter_band", "NO", "'visible'::filter_band", "5"),
    ("public", "exposure", "other_bands", "ARRAY", "_filter_band", "YES", None, "6"),
    ("public", "exposure", "seeing", "ARRAY", "_float4", "YES", None, "7"),
    ("public", "exposure", "header", "json", "json", "YES", None, "8"),
    ("public", "exposure", "pixels", "bytea", "bytea", "YES", None, "9"),
    ("public", "exposure", "started", "time without time zone", "time", "YES", None, "tenth"),
    ("public", "exposure", "remarks", "character varying", "varchar", "YES", None, "11"),
    ("public", "calibration", "frame_no", "integer", "int4", "NO", None, "1"),
    ("public", "calibration", "night", "date", "date", "NO", None, "2"),
    ("public", "calibration", "kind", "character varying", "varchar", "NO", "'dark'", "3"),
    ("public", "calibration", "offset_adu", "numeric", "numeric", "YES", None, "4"),
    ("public", "calibration", "quality", "USER-DEFINED", "verdict", "YES", None, "5"),
    ("public", "schema_ledger", "name", "text", "text", "NO", None, "1"),
    ("public", "schema_ledger", "checksum", "text", "text", "NO", None, "2"),
    ("public", "clear_nights", "night", "date", "date", "YES", None, "1"),
    ("ops", "rota", "astronomer", "text", "text", "NO", None, "1"),
]
PG_TABLE_ROWS = [
    ("public", "calibration", "BASE TABLE"),
    ("public", "clear_nights", "VIEW"),
    ("public", "exposure", "BASE TABLE"),
    ("public", "instrument", "BASE TABLE"),
    ("public", "schema_ledger", "BASE TABLE"),
    ("ops", "rota", "BASE TABLE"),
]
PG_CONSTRAINT_ROWS = [
    ("public", "calibration", "calibration_key", "PRIMARY KEY"),
    ("public", "exposure", "exposure_key", "PRIMARY KEY"),
    ("public", "exposure", "taken_with", "FOREIGN KEY"),
    ("public", "exposure", "positive_time", "CHECK"),
    ("public", "instrument", "instrument_key", "PRIMARY KEY"),
    ("public", "schema_ledger", "ledger_key", "PRIMARY KEY"),
    ("ops", "rota", "rota_key", "PRIMARY KEY"),
]
PG_USAGE_ROWS = [
    ("public", "calibration_key", "kind", "3"),
    ("public", "calibration_key", "night", "1"),
    ("public", "calibration_key", "frame_no", "2"),
    ("public", "exposure_key", "night", "1"),
    ("public", "exposure_key", "frame_no", "2"),
    ("public", "taken_with", "instrument_code", "1"),
    ("public", "instrument_key", "code", "1"),
    ("public", "ledger_key", "name", "1"),
    ("ops", "rota_key", "astronomer", "1"),
]
PG_FK_ROWS = [
    ("calibrates", "f", 7003, 7002, [2, 1], [1, 2]),
    ("positive_time", "c", 7002, 0, [4], [0]),
    ("taken_with", "f", 7002, 7001, [3], [1]),
    ("rota_instrument", "f", 8001, 7001, [2], [1]),
]
PG_CLASS_ROWS = [
    (7001, "instrument", 70), (7002, "exposure", 70), (7003, "calibration", 70), (8001, "rota", 80),
]
PG_NAMESPACE_ROWS = [(70, "public"), (80, "ops")]
PG_ATTRIBUTE_ROWS = [
    (7001, 1, "code"), (7001, 4, "serial"), (7002, 1, "night"), (7002, 2, "frame_no"), (7002, 3, "instrument_code"),
    (7002, 4, "seconds"), (7003, 1, "frame_no"), (7003, 2, "night"), (8001, 1, "astronomer"), (8001, 2, "code"),
]
PG_TYPE_ROWS = [(91, "filter_band", 70), (92, "verdict", 70), (93, "shift", 80)]
PG_ENUM_ROWS = [
    (91, 3, "near infrared"), (91, 1, "ultraviolet"), (91, 2, "visible"), (92, 20, "can't tell"), (92, 10, "segment"), (93, 1, "late"),
]
PG_INDEX_ROWS = [
    ("public", "instrument", "instrument_key", "CREATE UNIQUE INDEX instrument_key ON public.instrument USING btree (code)"),
    ("public", "instrument", "by_dome", "CREATE INDEX by_dome ON public.instrument USING gist (dome_address inet_ops)"),
    ("public", "exposure", "latest", 'CREATE INDEX latest ON public.exposure USING btree (night DESC, "frame_no" ASC NULLS FIRST)'),
    ("public", "exposure", "long_ones", "CREATE INDEX long_ones ON public.exposure USING btree (instrument_code) WHERE (seconds > 600)"),
    ("public", "exposure", "by_hour", "CREATE INDEX by_hour ON public.exposure USING btree (date_part('hour', started))"),
    ("public", "calibration", "calibration_key", "CREATE UNIQUE INDEX calibration_key ON public.calibration USING btree (night, frame_no, kind)"),
    ("public", "schema_ledger", "ledger_key", "CREATE UNIQUE INDEX ledger_key ON public.schema_ledger USING btree (name)"),
    ("ops", "rota", "rota_key", "CREATE UNIQUE INDEX rota_key ON ops.rota USING btree (astronomer)"),
]
PG_TRIGGER_ROWS = [
    ("public", "calibration", "stamp", "BEFORE", "UPDATE", "EXECUTE FUNCTION stamp_frame('calibration')"),
    ("public", "exposure", "tally", "AFTER", "INSERT", "EXECUTE FUNCTION tally_night()"),
    ("public", "exposure", "tally", "AFTER", "DELETE", "EXECUTE FUNCTION tally_night()"),
    ("public", "exposure", "tally", "AFTER", "UPDATE", "EXECUTE FUNCTION tally_night()"),
    ("ops", "rota", "no_doubles", "BEFORE", "INSERT", "EXECUTE FUNCTION ops.no_doubles()"),
]
# A harbour office: who berths where, what is on board, and the engine's own tables.
SQLITE_MASTER_ROWS = [
    ("table", "berth", "berth", "CREATE TABLE berth (...)"),
    ("table", "manifest", "manifest", "CREATE TABLE manifest (...)"),
    ("table", "tide", "tide", "CREATE TABLE tide (...)"),
    ("table", "schema_ledger", "schema_ledger", "CREATE TABLE schema_ledger (...)"),
    ("table", "sqlite_stat4", "sqlite_stat4", None),
    ("table", "SqLiTe9pins", "SqLiTe9pins", None),
    ("index", "sqlite_autoindex_manifest_1", "manifest", None),
    ("index", "manifest_by_mass", "manifest", "CREATE UNIQUE INDEX manifest_by_mass ON manifest (kilos DESC, abs(volume))"),
    ("index", "tide_at", "tide", "CREATE INDEX tide_at ON tide (at_minute)"),
    ("trigger", "loaded", "manifest", "CREATE TRIGGER loaded BEFORE DELETE ON manifest BEGIN INSERT INTO notes VALUES ('off'); END"),
    ("trigger", "insert_log", "tide", "create trigger insert_log after update of height on tide begin select 2; end"),
    ("trigger", "both_ways", "berth", "CREATE TRIGGER both_ways AFTER INSERT OR UPDATE ON berth BEGIN SELECT 3; END"),
    ("trigger", "on_view", "v_quay", "CREATE TRIGGER on_view INSTEAD OF INSERT ON v_quay BEGIN SELECT 4; END"),
]
SQLITE_COLUMN_ROWS = [
    ("berth", "0", "quay", "CHARACTER(4)", "1", None, "1"),
    ("berth", "1", "metres", "DOUBLE PRECISION", "0", "0.0", "0"),
    ("berth", "2", "lit", "bool", "1", "1", "0"),
    ("manifest", "0", "voyage", "MEDIUMINT", "0", None, "3"),
    ("manifest", "1", "hold", "TINYINT", "0", None, "1"),
    ("manifest", "2", "line_no", "INT8", "0", None, "2"),
    ("manifest", "3", "kilos", "DECIMAL(12,3)", "1", "0", "0"),
    ("manifest", "4", "volume", "FLOAT", "0", None, "0"),
    ("manifest", "5", "goods", "NVARCHAR(100)", "0", "'sundry'", "0"),
    ("manifest", "6", "photo", "BLOB", "0", None, "0"),
    ("manifest", "7", "quay", "clob", "0", None, "0"),
    ("tide", "0", "at_minute", "TIMESTAMP", "1", None, "1"),
    ("tide", "1", "height", "NUMERIC", "1", None, "0"),
    ("tide", "2", "moon", "PHASE OF MOON", "0", None, "0"),
    ("tide", "?", "remark", "", "0", None, "0"),
    ("schema_ledger", "0", "name", "TEXT", "1", None, "1"),
    ("sqlite_stat4", "0", "tbl", "TEXT", "0", None, "0"),
]
SQLITE_FK_ROWS = [
    ("tide", "0", "0", "berth", "moon", "quay", "NO ACTION"),
    ("manifest", "12345678901", "0", "berth", "quay", None, "SET NULL"),
    ("manifest", "12345678902", "1", "cargo_plan", "hold", "hold_no", "CASCADE"),
    ("manifest", "12345678902", "0", "cargo_plan", "voyage", "voyage_no", "CASCADE"),
]
SQLITE_INDEX_LIST_ROWS = [
    ("manifest", "sqlite_autoindex_manifest_1", "1", "pk"),
    ("manifest", "manifest_by_mass", "1", "c"),
    ("tide", "tide_at", "0", "c"),
]
SQLITE_INDEX_INFO_ROWS = [
    ("sqlite_autoindex_manifest_1", "2", "voyage"),
    ("sqlite_autoindex_manifest_1", "0", "hold"),
    ("sqlite_autoindex_manifest_1", "1", "line_no"),
    ("manifest_by_mass", "0", "kilos"),
    ("manifest_by_mass", "1", None),
    ("tide_at", "0", "at_minute"),
]


def _fleet(d, rows, names: str, select: str) -> str:
    """One copy of the catalogue rows per customer, each customer being a database."""
    source = d.spread(d.dealt("customer"), names.split(), rows)
    return f"SELECT CAST(c_custkey AS STRING) AS db_id, {select} FROM {source}"


def pg_columns(d, changed: bool = True) -> str:
    """Columns; some databases lost a column, have another type or allow nulls."""
    names = "table_schema table_name column_name dt ut nul column_default ordinal_position"
    plain = "table_schema, table_name, column_name, {} AS data_type, {} AS udt_name, {} AS is_nullable, column_default, ordinal_position"
    if not changed:
        return _fleet(d, PG_COLUMN_ROWS, names, plain.format("dt", "ut", "nul"))
    wide = "c_acctbal < 0 AND column_name = 'offset_adu'"
    sql = _fleet(
        d, PG_COLUMN_ROWS, names,
        plain.format(
            f"CASE WHEN {wide} THEN 'double precision' ELSE dt END",
            f"CASE WHEN {wide} THEN 'float8' ELSE ut END",
            "CASE WHEN c_custkey % 7 = 0 AND column_name = 'instrument_code' THEN 'NO' ELSE nul END",
        ),
    )
    return sql + " WHERE NOT (c_custkey % 11 = 0 AND column_name = 'remarks')"


def pg_tables(d) -> str:
    names = "table_schema table_name table_type"
    return _fleet(d, PG_TABLE_ROWS, names, names.replace(" ", ", "))


def pg_table_constraints(d) -> str:
    names = "table_schema table_name constraint_name constraint_type"
    return _fleet(
        d, PG_CONSTRAINT_ROWS, names, names.replace(" ", ", ") + ", table_schema AS constraint_schema"
    )


def pg_key_column_usage(d, changed: bool = False) -> str:
    """Key columns; after a change some databases lost a member of a key."""
    names = "constraint_schema constraint_name column_name ordinal_position"
    sql = _fleet(d, PG_USAGE_ROWS, names, names.replace(" ", ", "))
    return sql + " WHERE NOT (c_custkey % 13 = 0 AND column_name = 'kind')" if changed else sql


def pg_constraint(d, changed: bool = False) -> str:
    """Constraints; after a change some databases lost a key or have another action."""
    names = "conname contype conrelid confrelid conkey confkey"
    update = "CASE WHEN c_custkey % 9 = 0 THEN 'c' ELSE 'a' END" if changed else "'a'"
    sql = _fleet(
        d, PG_FK_ROWS, names,
        names.replace(" ", ", ")
        + f", substr('arcnd', CAST(c_custkey % 5 + 1 AS INT), 1) AS confdeltype, {update} AS confupdtype",
    )
    return sql + " WHERE NOT (c_custkey % 6 = 0 AND conname = 'calibrates')" if changed else sql


def pg_class(d) -> str:
    return _fleet(d, PG_CLASS_ROWS, "oid relname relnamespace", "oid, relname, relnamespace")


def pg_namespace(d) -> str:
    return _fleet(d, PG_NAMESPACE_ROWS, "oid nspname", "oid, nspname")


def pg_attribute(d) -> str:
    return _fleet(d, PG_ATTRIBUTE_ROWS, "attrelid attnum attname", "attrelid, attnum, attname")


def pg_type(d) -> str:
    return _fleet(d, PG_TYPE_ROWS, "oid typname typnamespace", "oid, typname, typnamespace")


def pg_enum(d) -> str:
    return _fleet(
        d, PG_ENUM_ROWS, "enumtypid enumsortorder label",
        "enumtypid, enumsortorder, CASE WHEN label = 'segment' THEN lower(c_mktsegment) ELSE label END AS enumlabel",
    )


def pg_indexes(d, changed: bool = True) -> str:
    names = "schemaname tablename indexname indexdef"
    sql = _fleet(d, PG_INDEX_ROWS, names, names.replace(" ", ", "))
    return sql + " WHERE NOT (c_custkey % 3 = 0 AND indexname = 'long_ones')" if changed else sql


def pg_triggers(d, changed: bool = True) -> str:
    names = "trigger_schema event_object_table trigger_name action_timing event_manipulation action_statement"
    sql = _fleet(d, PG_TRIGGER_ROWS, names, names.replace(" ", ", "))
    return sql + " WHERE NOT (c_custkey % 5 = 0 AND event_manipulation = 'UPDATE')" if changed else sql


def _files(d, rows, names: str, select: str) -> str:
    """One copy of the SQLite catalogue rows per part, each part being a database file."""
    source = d.spread(d.dealt("part"), names.split(), rows)
    return f"SELECT CAST(p_partkey AS STRING) AS db_id, {select} FROM {source}"


def sqlite_master(d) -> str:
    return _files(d, SQLITE_MASTER_ROWS, "kind name tbl_name sql", "kind AS type, name, tbl_name, sql")


def sqlite_columns(d, changed: bool = False) -> str:
    """Columns; a table made anew has lost a default in some files."""
    lost = "CASE WHEN p_size % 4 = 0 AND name = 'kilos' THEN NULL ELSE dflt_value END" if changed else "dflt_value"
    return _files(
        d, SQLITE_COLUMN_ROWS, "table_name cid name decl nn dflt_value pk",
        "table_name, cid, name, CASE WHEN p_size % 9 = 0 AND decl IN ('FLOAT', 'NUMERIC') THEN lower(p_type) ELSE decl END AS type, "
        f"nn AS `notnull`, {lost} AS dflt_value, pk",
    )


def sqlite_foreign_keys(d, changed: bool = False) -> str:
    """Foreign keys; ``manifest`` made anew has one more in front, which renumbers the others,
    and some files lost the key of another table."""
    number = "CASE WHEN table_name = 'manifest' THEN CAST(CAST(id AS BIGINT) + 1 AS STRING) ELSE id END" if changed else "id"
    rows = SQLITE_FK_ROWS + ([("manifest", "-1", "0", "tide", "line_no", "at_minute", "RESTRICT")] if changed else [])
    sql = _files(
        d, rows, "table_name id seq target here there on_update",
        f"table_name, {number} AS id, seq, target AS `table`, here AS `from`, there AS `to`, on_update, "
        "CASE WHEN p_size % 2 = 0 THEN 'CASCADE' ELSE 'SET NULL' END AS on_delete",
    )
    return sql + " WHERE NOT (p_size % 7 = 0 AND table_name = 'tide')" if changed else sql


def sqlite_index_list(d, changed: bool = False) -> str:
    """Indexes; a table made anew has lost one that nobody declared again."""
    sql = _files(
        d, SQLITE_INDEX_LIST_ROWS, "table_name name uniq origin",
        "table_name, name, uniq AS `unique`, origin",
    )
    return sql + " WHERE NOT (p_size % 3 = 0 AND name = 'manifest_by_mass')" if changed else sql


def sqlite_index_info(d) -> str:
    names = "index_name seqno name"
    return _files(d, SQLITE_INDEX_INFO_ROWS, names, names.replace(" ", ", "))


def duck(sql: str) -> str:
    """Identifiers quoted the DuckDB way."""
    return sql.replace("`", '"')
