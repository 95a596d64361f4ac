"""Schema reports, contracts and comparison on small catalogues."""

import json

from pyspark.sql import functions as F

from tidemark.operators import catalog as cat, contracts
from tidemark.plans import calls
from tidemark.sources import catalog as rows_of, schemas


def frame(spark, schema, rows):
    return spark.createDataFrame([("d", *r) for r in rows], schema)


def pg(spark):
    """Weather stations: a station has sensors, a sensor many readings; ``grade`` is an enum."""
    columns = frame(spark, schemas.PG_COLUMNS, [
        ("public", "station", "code", "character", "bpchar", "NO", None, "2"),
        ("public", "station", "metres", "double precision", "float8", "YES", "0", "1"),
        ("public", "reading", "taken", "timestamp without time zone", "timestamp", "NO", "localtimestamp", "4"),
        ("public", "reading", "station_code", "character", "bpchar", "NO", None, "1"),
        ("public", "reading", "sensor", "smallint", "int2", "NO", None, "2"),
        ("public", "reading", "grades", "ARRAY", "_grade", "YES", "'{}'::grade[]", "3"),
        ("public", "reading", "raw", "json", "json", "YES", None, "?"),
        ("public", "schema_ledger", "applied_at", "date", "date", "NO", None, "1"),
        ("public", "latest", "taken", "date", "date", "YES", None, "1"),
        ("archive", "reading_2020", "taken", "date", "date", "YES", None, "1"),
    ])
    base = ["station", "reading", "schema_ledger"]
    tables = frame(spark, schemas.PG_TABLES, [
        *(("public", t, "BASE TABLE") for t in base), ("public", "latest", "VIEW"), ("archive", "reading_2020", "BASE TABLE"),
    ])
    constraints = frame(spark, schemas.PG_TABLE_CONSTRAINTS, [
        ("public", "station", "public", "station_once", "UNIQUE"),
        ("public", "reading", "public", "reading_id", "PRIMARY KEY"),
        ("archive", "reading_2020", "archive", "reading_id", "PRIMARY KEY"),
    ])
    usage = frame(spark, schemas.PG_KEY_COLUMN_USAGE, [
        ("public", "station_once", "code", "1"),
        ("public", "reading_id", "sensor", "3"), ("public", "reading_id", "taken", "1"), ("public", "reading_id", "station_code", "2"),
        ("archive", "reading_id", "taken", "1"),
    ])
    constraint = frame(spark, schemas.PG_CONSTRAINT, [
        ("reading_of", "f", 71, 70, [11, 12, 13], [5, 7, 6], "n", "d"), ("old_of", "f", 72, 70, [1], [5], "a", "a"), ("reading_id", "p", 71, 0, [14], None, None, None),
    ])
    classes = frame(spark, schemas.PG_CLASS, [(70, "station", 30), (71, "reading", 30), (72, "reading_2020", 31)])
    namespace = frame(spark, schemas.PG_NAMESPACE, [(30, "public"), (31, "archive")])
    attribute = frame(spark, schemas.PG_ATTRIBUTE, [
        (70, 5, "code"), (70, 6, "region"), (70, 7, "land"), (71, 11, "station_code"), (71, 12, "station_land"), (71, 13, "station_region"), (72, 1, "taken"),
    ])
    types = frame(spark, schemas.PG_TYPE, [(90, "grade", 30), (91, "grade", 31)])
    enums = frame(spark, schemas.PG_ENUM, [(90, 1.5, "fair"), (90, 0.5, "poor"), (90, 9.0, "dead'on"), (91, 1.0, "old")])
    indexes = frame(spark, schemas.PG_INDEXES, [
        ("public", "reading", "by_sensor", "CREATE UNIQUE INDEX by_sensor ON public.reading USING btree (sensor DESC, taken)"),
        ("public", "reading", "by_year", "CREATE INDEX by_year ON public.reading USING btree (date_part('year'::text, taken))"),
        ("public", "schema_ledger", "led", "CREATE INDEX led ON public.schema_ledger USING btree (applied_at)"),
    ])
    triggers = frame(spark, schemas.PG_TRIGGERS, [
        ("public", "station", event_of, "BEFORE", event, "EXECUTE FUNCTION stamp()")
        for event_of, event in (("stamped", "UPDATE"), ("stamped", "DELETE"), ("stamped", "INSERT"), ("closed", "DELETE"))
    ])
    return {
        "columns": cat.pg_columns(columns, tables),
        "keys": cat.pg_keys(constraints, usage),
        "foreign": cat.pg_foreign(constraint, classes, namespace, attribute),
        "enums": cat.pg_enum_labels(types, enums, namespace),
        "indexes": cat.pg_index_rows(indexes),
        "triggers": cat.pg_trigger_rows(triggers),
    }


def report(parts, **kw):
    got = calls.schema(parts["columns"], parts["keys"], parts["foreign"], parts["indexes"], parts["triggers"], parts.get("enums"), **kw)
    return {r.table_name: r for r in got["tables"].collect()}, got


def test_postgres_report(spark):
    tables, got = report(pg(spark))
    assert sorted(tables) == ["reading", "station"]  # no ledger, no view, no other schema
    station, reading = tables["station"], tables["reading"]
    assert [(c.column_name, c.nullable, c.default) for c in station.columns] == [("metres", True, "0"), ("code", False, None)]
    assert station.primary_key == [] and station.foreign_keys == [] and station.indexes == []  # unique is no primary key
    assert {t.trigger_name: (t.timing, t.events) for t in station.triggers} == {
        "stamped": ("BEFORE", ["DELETE", "INSERT", "UPDATE"]), "closed": ("BEFORE", ["DELETE"]),
    }
    # An unreadable place counts as 0 and comes first; the key has an order of its own.
    assert [(c.column_name, c.position) for c in reading.columns] == [("raw", 0), ("station_code", 1), ("sensor", 2), ("grades", 3), ("taken", 4)]
    assert reading.primary_key == ["taken", "station_code", "sensor"]
    assert [tuple(k) for k in reading.foreign_keys] == [
        ("reading_of", ["station_code", "station_land", "station_region"], "station", ["code", "land", "region"], "SET NULL", "SET DEFAULT")
    ]
    assert [(i.index_name, i.is_unique, i.columns) for i in reading.indexes] == [("by_sensor", True, ["sensor", "taken"]), ("by_year", False, [])]
    assert [(e.enum_name, e.labels) for e in got["enums"].collect()] == [("grade", ["poor", "fair", "dead'on"])]


def test_one_table_and_an_unknown_one(spark):
    for table, found in (("station", {"station"}), ("latest", set()), ("Station", set())):
        assert set(report(pg(spark), table=table)[0]) == found


def test_contract(spark):
    parts = pg(spark)
    got = calls.codegen(parts["columns"], parts["enums"])
    text = {(r.kind, r.name): r.text for r in got["rows"].collect()}
    assert text == {
        ("alias", "Json"): contracts.JSON_ALIAS,
        ("enum", "grade"): "export type Grade = 'poor' | 'fair' | 'dead\\'on';",
        ("table", "station"): "export interface Station {\n  metres: number | null;\n  code: string;\n}",
        ("table", "reading"): "export interface Reading {\n  raw: Json | null;\n  station_code: string;\n  sensor: number;\n  grades: Grade[] | null;\n  taken: string;\n}",
        ("member", "station"): "  station: Station;",
        ("member", "reading"): "  reading: Reading;",
    }
    assert [(r.tables, r.enums) for r in got["counts"].collect()] == [(2, 1)]


def sqlite(spark):
    """A seed bank, with the engine's own tables and one whose name only looks like them."""
    master = frame(spark, schemas.SQLITE_MASTER, [
        *(("table", t, t, None) for t in ("seed", "lot", "sqliteish", "sqlite_stat1", "SQLiteZone", "schema_ledger", "sqlight")),
        ("index", "sqlite_autoindex_lot_1", "lot", None),
        ("index", "lot_by_year", "lot", "CREATE UNIQUE INDEX lot_by_year ON lot (year, upper(box))"),
        ("trigger", "lot_gone", "lot", "CREATE TRIGGER lot_gone BEFORE DELETE ON lot BEGIN SELECT 1; END"),
    ])
    columns = frame(spark, schemas.SQLITE_COLUMNS, [
        ("seed", "0", "latin", "NVARCHAR(60)", "0", "'unnamed'", "1"), ("seed", "1", "grams", "REAL", "1", None, "0"),
        ("lot", "0", "box", "TINYTEXT", "0", None, "3"), ("lot", "1", "year", "SMALLINT", "0", None, "1"), ("lot", "2", "shelf", "INT", "0", None, "2"),
        ("lot", "3", "alive", "BOOLEAN", "1", "1", "0"), ("lot", "4", "latin", None, "0", None, "0"),
        ("sqlight", "0", "lux", "FLOAT", "0", None, "0"), ("schema_ledger", "0", "name", "TEXT", "1", None, "1"),
    ])
    foreign = frame(spark, schemas.SQLITE_FOREIGN_KEYS, [
        ("lot", "12345678902", "0", "shelves", "year", "opened", "RESTRICT", "SET NULL"), ("lot", "12345678902", "1", "shelves", "shelf", "no", "RESTRICT", "SET NULL"),
        ("lot", "12345678901", "0", "seed", "latin", None, "CASCADE", "CASCADE"),
    ])
    listed = frame(spark, schemas.SQLITE_INDEX_LIST, [("lot", "lot_by_year", "1", "c"), ("lot", "sqlite_autoindex_lot_1", "1", "pk")])
    info = frame(spark, schemas.SQLITE_INDEX_INFO, [
        ("lot_by_year", "0", "year"), ("lot_by_year", "1", None),
        *(("sqlite_autoindex_lot_1", str(n), c) for n, c in ((2, "box"), (0, "year"), (1, "shelf"))),
    ])
    tables = cat.sqlite_tables(master)
    return {
        "columns": cat.sqlite_columns(tables, columns),
        "keys": cat.sqlite_keys(tables, columns),
        "foreign": cat.sqlite_foreign(tables, foreign),
        "indexes": cat.sqlite_index_rows(tables, listed, info, master),
        "triggers": cat.sqlite_trigger_rows(tables, master),
    }


def test_sqlite_report(spark):
    tables, _ = report(sqlite(spark))
    assert set(tables) == {"seed", "lot", "sqlight"}
    lot = tables["lot"]
    assert {c.column_name: c.nullable for c in lot.columns} == {"box": False, "year": False, "shelf": False, "alive": False, "latin": True}
    assert lot.primary_key == ["year", "shelf", "box"]
    # Long ids stay apart and sort as numbers.
    assert [(k.name, k.columns, k.references_table, k.references_columns, k.on_delete) for k in lot.foreign_keys] == [
        (None, ["latin"], "seed", [], "CASCADE"), (None, ["year", "shelf"], "shelves", ["opened", "no"], "SET NULL"),
    ]
    assert [(i.index_name, i.is_unique, i.columns, i.definition is None) for i in lot.indexes] == [
        ("lot_by_year", True, ["year"], False), ("sqlite_autoindex_lot_1", True, ["year", "shelf", "box"], True),
    ]
    assert [(t.timing, t.events) for t in lot.triggers] == [("BEFORE", ["DELETE"])]
    assert [(c.column_name, c.default) for c in tables["seed"].columns] == [("latin", "'unnamed'"), ("grams", None)]


def test_sqlite_contract(spark):
    rows = calls.codegen(sqlite(spark)["columns"], None)["rows"]
    text = {r.name: r.text for r in rows.collect() if r.kind == "table"}
    assert text["lot"] == "export interface Lot {\n  box: string;\n  year: number;\n  shelf: number;\n  alive: boolean;\n  latin: string | null;\n}"


def test_schema_diff_lists_only_what_differs(spark):
    """Equal rows are counted where both sides meet; definitions are listed for other objects only."""
    cols = "db_id string, table_name string, kind string, object_name string, definition string"
    before = [("d", "t", "index", None, "x"), ("d", "t", "index", "same", "y"), ("d", "t", "foreign_key", "two", "p"), ("d", "t", "foreign_key", "two", "p"), ("d", "t", "column", "gone", None)]
    after = [("d", "t", "index", None, "z"), ("d", "t", "index", "same", "y"), ("d", "t", "foreign_key", "two", "p"), ("d", "t", "foreign_key", "two", "q")]
    got = cat.schema_diff(spark.createDataFrame(before, cols), spark.createDataFrame(after, cols))
    assert {(r.object_name, r.state, r.before, r.after) for r in got.collect()} == {
        (None, "changed", "x", "z"), ("two", "changed", "p; p", "p; q"), ("gone", "removed", "-", None),
    }
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above, below = plan.split("ShuffledHashJoin")
    assert "collect_list" in above and "collect_list" not in below


def test_schema_diff(spark):
    parts = pg(spark)
    order = ["columns", "keys", "foreign", "indexes", "triggers"]
    before = cat.schema_objects(*[parts[k] for k in order])
    lost = {**parts, "indexes": parts["indexes"].where("index_name <> 'by_year'"), "foreign": parts["foreign"].limit(0)}
    lost["columns"] = parts["columns"].withColumn("default", parts["columns"]["default"].substr(1, 3))
    after = cat.schema_objects(*[lost[k] for k in order])
    got = {(r.kind, r.object_name, r.state) for r in cat.schema_diff(before, after).collect()}
    assert got == {
        ("index", "by_year", "removed"), ("foreign_key", "reading_of", "removed"),
        ("column", "grades", "changed"), ("column", "taken", "changed"),
    }
    assert {r.state for r in cat.schema_diff(after, before).collect()} == {"added", "changed"}


def test_keys_without_a_name_go_by_what_they_connect(spark):
    """A key added in front renumbers the others, which is no change of theirs."""
    parts = sqlite(spark)
    order = ["columns", "keys", "foreign", "indexes", "triggers"]
    before = cat.schema_objects(*[parts[k] for k in order])
    one = parts["foreign"].withColumn("fk_key", F.col("fk_key") + 1)
    added = one.where("column_name = 'latin'").withColumns({"fk_key": F.lit(0), "column_name": F.lit("box"), "references_table": F.lit("crate")})
    after = cat.schema_objects(*[{**parts, "foreign": one.unionByName(added)}[k] for k in order])
    got = [(r.kind, r.object_name, r.state) for r in cat.schema_diff(before, after).collect()]
    assert got == [("foreign_key", "box -> crate", "added")]
    # The same columns twice, one of them with another action.
    twice = cat.schema_objects(*[{**parts, "foreign": one.unionByName(one.where("column_name = 'latin'").withColumns({"fk_key": F.lit(9), "on_delete": F.lit("RESTRICT")}))}[k] for k in order])
    assert [(r.object_name, r.state) for r in cat.schema_diff(before, twice).collect()] == [("latin -> seed", "changed")]


def test_renamed_objects_are_matched_by_content(spark):
    cols = "db_id string, table_name string, kind string, object_name string, definition string"
    before = [("d", "t", "index", "a", "CREATE INDEX a ON t (x, y)"), ("d", "t", "index", "b", "CREATE INDEX b ON t (z)"), ("d", "t", "column", "n", "int true 7"), ("d", "u", "index", "q", "CREATE INDEX q ON u (x)")]
    after = [("d", "t", "index", "b2", "CREATE INDEX b2 ON t (z)"), ("d", "t", "index", "a2", "CREATE INDEX a2 ON t (x, y)"), ("d", "t", "column", "m", "text false -"), ("e", "u", "index", "q2", "CREATE INDEX q2 ON u (x)")]
    diff = cat.schema_diff(spark.createDataFrame(before, cols), spark.createDataFrame(after, cols))
    got = {(r.old_name, r.new_name, r.percent_shared) for r in cat.renamed(diff).collect()}
    assert got == {("a", "a2", 100), ("b", "b2", 100)}


def test_a_report_meets_in_one_shuffle(spark):
    parts = sqlite(spark)
    flat = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in parts.items()}
    report = calls.schema(flat["columns"], flat["keys"], flat["foreign"], flat["indexes"], flat["triggers"])["tables"]
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_fleet_drift(spark):
    rows = [(f"d{i}", "t", c, "text" if (i, c) != (3, "b") else "int", False, None, p) for i in range(5) for p, c in enumerate("ab")]
    df = spark.createDataFrame(rows, "db_id string, table_name string, column_name string, data_type string, nullable boolean, default string, position bigint")
    assert [(r.db_id, r.votes, r.forms) for r in cat.fleet_schema_drift(df).collect()] == [("d3", 4, 2)]


def test_numbers_sent_as_text_or_number(spark, tmp_path):
    folder = tmp_path / "columns"
    folder.mkdir()
    lines = [{"db_id": "d", "column_name": "a", "ordinal_position": 1}, {"db_id": "d", "column_name": "b", "ordinal_position": "2"}, {"db_id": "d", "column_default": 0}]
    (folder / "x.json").write_text("\n".join(map(json.dumps, lines)))
    got = rows_of.read_rows(spark, str(tmp_path), "columns").collect()
    assert {(r.column_name, r.ordinal_position, r.column_default) for r in got} == {("a", "1", None), ("b", "2", None), (None, None, "0")}
