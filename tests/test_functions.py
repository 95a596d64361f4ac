"""Column expressions against cases written by hand."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ddl, errors, names, types
from tidemark.functions.hashing import checksum, raw_checksum
from tidemark.functions.text import pascal_case, property_name
from tidemark.functions.wire import wire_row


def evaluate(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    rows = df.select("i", fn(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def named():
    """A sound name, and every way of spoiling one of its parts."""
    day, slug = "20310405061728", "load_ballast-2"
    out = {f"{d}_{s}.sql": None for d in (day, "00000000000000", "99999999999999") for s in (slug, "-", "_", "Z9", "x" * 200)}
    for k in range(14):
        out[f"{day[:k]}x{day[k + 1:]}_{slug}.sql"] = names.BAD_PREFIX
    for k in (0, 5, 13):
        out[f"{day[:k]}{day[k + 1:]}_{slug}.sql"] = names.BAD_PREFIX
    for joint in ("-", ".", " ", "", "é"):
        out[f"{day}{joint}{slug}.sql"] = names.NO_UNDERSCORE
    for bad in (" ", ".", "!", "ß", "\n", "\t", "/"):
        out |= {f"{day}_{s}.sql": names.BAD_SLUG for s in (bad, f"hull{bad}", f"{bad}hull", f"hu{bad}ll")}
    for end in ("", ".SQL", ".sql ", ".sqlx", ".txt"):
        out[f"{day}_{slug}{end}"] = names.NO_EXTENSION
    for k in range(14):
        out[f"{day[:k]}.sql"] = names.TOO_SHORT
    return out | {f"{day}_.sql": names.EMPTY_SLUG, f"{day}.sql": names.NO_UNDERSCORE, f"{day[:13]}ö.sql": names.TOO_SHORT, f"{day[:12]}ö_y.sql": names.BAD_PREFIX}


NAMES = named()


def test_invalid_reason(spark):
    assert evaluate(spark, list(NAMES), names.invalid_reason) == list(NAMES.values())


def test_is_valid_agrees_with_the_reason(spark):
    valid = evaluate(spark, list(NAMES), names.is_valid)
    assert valid == [r is None for r in NAMES.values()]


def test_instant_and_future(spark):
    """Times are read where they exist in the calendar; five minutes ahead is not yet ahead."""
    rng = random.Random(5)
    stamps = ["".join((f"{rng.randint(1, 9999):04d}", *(f"{rng.randint(0, top):02d}" for top in (14, 33, 26, 62, 62)))) for _ in range(400)]

    def read(x):
        try:
            return datetime.datetime.strptime(x, "%Y%m%d%H%M%S") if x[12:] < "60" else None
        except ValueError:
            return None

    at = evaluate(spark, [f"{x}_berth.sql" for x in stamps], lambda c: names.instant(c).cast("string"))
    assert at == [t and f"{t:%H:%M:%S}".join((f"{t.year:04d}-{t:%m-%d} ", "")) for t in map(read, stamps)]
    now = datetime.datetime(2031, 4, 5, 23, 58)
    shifts = [-86400, -1, 0, 299, 300, 301, 3600, 10**7]
    ahead = evaluate(
        spark, [f"{now + datetime.timedelta(seconds=x):%Y%m%d%H%M%S}_b.sql" for x in shifts] + ["b.sql"], lambda c: names.is_future_dated(c, str(now))
    )
    assert ahead == [x > 300 for x in shifts] + [False]


def test_prefix_round_trip(spark):
    top = 253402300799  # the last second of the year 9999
    seconds = [0, -1, top, top + 1, *random.Random(9).sample(range(top), 50)]
    epoch = datetime.datetime(1970, 1, 1)
    want = [None if x > top else (epoch + datetime.timedelta(seconds=x)).strftime("%Y%m%d%H%M%S") for x in seconds]
    assert evaluate(spark, seconds, names.prefix_of, "bigint") == want


def test_slugs(spark):
    bodies = {"quay": "quay", "lee-shore": "lee-shore", "": "migration", "fjörd två": "fj_rd_tv_", "a.b": "a_b", "_": "_", "x  y": "x__y"}
    tags = {f"{n}_{body}": slug for n in ("0000", "0417", "12345") for body, slug in bodies.items()}
    tags |= {"quay_only": "quay_only", "77": "77", "_0001_q": "_0001_q"}
    assert evaluate(spark, list(tags), names.tag_slug) == list(tags.values())
    asked = {"\tdock-4 ": "dock-4", "dock": "dock", "do ck": None, "   ": None, "": None, "dø": None}
    assert evaluate(spark, list(asked), names.requested_slug) == list(asked.values())


def test_hashes_of_any_bytes(spark):
    rng = random.Random(7)
    contents = [b"", b"hello", b"a\r\r\nb", b"\r\n\r\n", b"x\ry"] + [
        bytes(rng.choice([13, 10, 65, 0, 255, 0xC3, 0x80]) for _ in range(rng.randint(0, 60))) for _ in range(300)
    ]
    norm = evaluate(spark, contents, checksum, "binary")
    raw = evaluate(spark, contents, raw_checksum, "binary")
    assert norm == [hashlib.sha256(c.replace(b"\r\n", b"\n")).hexdigest() for c in contents]
    assert raw == [hashlib.sha256(c).hexdigest() for c in contents]


def test_pascal_and_properties(spark):
    words = {"tide": "Tide", "high_tide": "HighTide", "high-tide": "HighTide", "__a_b c": "ABC", "øre_x": "øreX", "EBB_flow": "EBBFlow", "m2_3k": "M23k"}
    assert evaluate(spark, list(words), pascal_case) == list(words.values())
    plain = ["tide", "_t", "$t9", "T_9"]
    assert evaluate(spark, plain, property_name) == plain
    quoted = ["9t", "high tide", "o'clock", "", "t\n", "é"]
    assert evaluate(spark, quoted, property_name) == ["'" + q.replace("'", "\\'") + "'" for q in quoted]


# Declared types by what they turn into; names are matched in either case and with a size.
SQLITE = {
    t: wire
    for wire, families in {
        "number": ["smallint", "INT2", "unsigned big int", "float", "double precision", "numeric", "DECIMAL"],
        "string": ["nchar", "native character", "clob", "text", "blob", "timestamp", "date"],
        "boolean": ["bool", "BOOLEAN"],
        "unknown": ["moon phase"],
    }.items()
    for family in families
    for t in (family, family.upper(), *([f"{family}(7,2)"] if wire == "number" else []))
} | {"": "string", None: "string"}


def test_sqlite_types(spark):
    assert evaluate(spark, list(SQLITE), types.sqlite_wire) == list(SQLITE.values())


_SCALARS = {"int2": "number", "float8": "number", "int8": "string", "numeric": "string", "bool": "boolean", "date": "string", "inet": "string", "jsonb": "Json"}
_DECLARED = {"int2": "smallint", "float8": "double precision", "int8": "bigint", "bool": "boolean"}
PG = [(_DECLARED.get(u, u), u, w) for u, w in _SCALARS.items()]
PG += [("ARRAY", f"_{u}", f"{w}[]") for u, w in _SCALARS.items()]
PG += [("USER-DEFINED", "mood", "Mood"), ("ARRAY", "_mood", "Mood[]"), ("USER-DEFINED", "hstore_like", "unknown")]


def test_pg_types(spark):
    df = spark.createDataFrame([(i, *row[:2]) for i, row in enumerate(PG)], "i int, d string, u string")
    element = types.pg_element(F.col("d"), F.col("u"))
    enum = F.when(element == "mood", "Mood")
    rows = df.select("i", types.pg_wire(F.col("d"), element, enum).alias("w")).orderBy("i").collect()
    assert [r.w for r in rows] == [row[2] for row in PG]


_MEMBERS = {"depth": "depth", "depth DESC": "depth", "depth ASC NULLS FIRST": "depth", '"Draft"': "Draft"}
_ODD_MEMBERS = ["abs(depth)", "depth int4_ops", "depth COLLATE x", "(depth)"]
_SHAPE = "CREATE INDEX soundings ON sea.bed USING gist ({}){}"
INDEXES = {_SHAPE.format(f"{m}, {n}", w): [a, b] for m, a in _MEMBERS.items() for n, b in _MEMBERS.items() for w in ("", " WHERE (depth > 3)")}
INDEXES |= {_SHAPE.format(", ".join(p), ""): [] for o in _ODD_MEMBERS for p in ([o], ["depth", o], [o, "depth"])}
INDEXES |= {_SHAPE.format("", ""): [], "CREATE INDEX open ON bed (depth": [], "no list at all": [], "CREATE UNIQUE INDEX one ON bed (depth)": ["depth"]}


def test_index_columns(spark):
    assert evaluate(spark, list(INDEXES), ddl.index_columns) == list(INDEXES.values())
    unique = evaluate(spark, list(INDEXES), ddl.index_is_unique)
    assert [u for u in unique if u] == [True]


def parse_members(definition):
    """A direct reading of the first bracket, for comparison."""
    if "(" not in definition:
        return []
    depth, inner = 0, ""
    for ch in definition[definition.index("(") :]:
        depth += (ch == "(") - (ch == ")")
        if depth == 0:
            break
        inner += ch
    else:
        return []
    out = []
    for member in inner[1:].split(","):
        words = member.split()
        if "(" in member or not words or set(words[1:]) - {"ASC", "DESC", "NULLS", "FIRST", "LAST"}:
            return []
        out.append(words[0].strip('"'))
    return out


def test_index_columns_on_random_definitions(spark):
    rng = random.Random(2)
    bits = ["(", ")", ",", " ", "a", '"b"', "DESC", " ASC ", "NULLS LAST", "lower", "x y", ") WHERE ("]
    texts = ["CREATE INDEX i ON t " + "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    texts += [f"CREATE INDEX i ON t USING btree ({', '.join(rng.choice(bits) for _ in range(3))})" for _ in range(1000)]
    assert evaluate(spark, texts, ddl.index_columns) == [parse_members(t) for t in texts]


def test_trigger_headers(spark):
    """Timing and events are read from the words before BEGIN; the name is one of them."""
    cases = {
        "CREATE TRIGGER ebb BEFORE INSERT ON tide BEGIN UPDATE log SET n = 2; END": ("BEFORE", ["INSERT"]),
        "create trigger flow after delete or update on tide begin insert into log values (1); end": ("AFTER", ["DELETE", "UPDATE"]),
        "CREATE TRIGGER spring INSTEAD OF UPDATE ON v BEGIN SELECT 1; END": ("INSTEAD OF", ["UPDATE"]),
        "CREATE TRIGGER neap DELETE ON tide BEGIN SELECT 1; END": ("AFTER", ["DELETE"]),
        "CREATE TRIGGER insert_mark DELETE ON tide BEGIN SELECT 1; END": ("AFTER", ["DELETE", "INSERT"]),
        None: ("AFTER", []),
    }
    assert evaluate(spark, list(cases), ddl.trigger_timing) == [t for t, _ in cases.values()]
    assert evaluate(spark, list(cases), ddl.trigger_events) == [e for _, e in cases.values()]


def worker(message, code="E_BERTH", inner=None, driver=None, index=None):
    return ("worker", code, message, inner, driver, index)


def remote(body, expected, code="E_OUTER"):
    return ("remote", code, body, expected)


def as_is(body):
    """A body that is no error record is the message itself."""
    return remote(body, worker(body, "E_OUTER"))


_TAKEN = '"code":"E_BERTH","message":"berth taken"'
ERRORS = [
    ("timeout", "c", "m", ("unavailable", None, "invocation timed out", None, None, None)),
    ("not_connected", None, "m", ("unavailable", None, "engine not connected", None, None, None)),
    ("whatever", None, "line cut", ("unavailable", None, "line cut", None, None, None)),
    (
        "remote", "function_not_found", "no pilot",
        ("unavailable", None, "database worker function not registered (no pilot); is the database worker running?", None, None, None),
    ),
    remote(f"{{{_TAKEN}}}", worker("berth taken")),
    remote(f'while mooring: {{{_TAKEN},"driver":"sqlite","failed_index":4}}', worker("berth taken", driver="sqlite", index=4)),
    remote(f'{{{_TAKEN},"inner_code":"23505"}}', worker("berth taken (SQLSTATE 23505)", inner="23505")),
    remote(f'{{{_TAKEN},"inner_code":"19","driver":"sqlite"}}', worker("berth taken (sqlite error code 19)", inner="19", driver="sqlite")),
    as_is("all hands"), as_is('{"message":"who knows"}'), as_is(f"{{{_TAKEN}}} and more"), as_is(f"{{{_TAKEN}}}{{{_TAKEN}}}"),
    remote('{"code":1,"message":2}', worker('{"code":1,"message":2}', None)),
    remote('q {"code":null,"failed_index":-3}', worker('q {"code":null,"failed_index":-3}', None)),
]


def test_error_bodies(spark):
    df = spark.createDataFrame([(i, *e[:3]) for i, e in enumerate(ERRORS)], "i int, kind string, code string, message string")
    rows = errors.normalise(df).orderBy("i").collect()
    got = [(r.error_kind, r.error_code, r.error_message, r.inner_code, r.driver, r.failed_index) for r in rows]
    assert got == [e[3] for e in ERRORS]


def test_caller_codes(spark):
    df = spark.createDataFrame(
        [("worker", "UNKNOWN_DB", "no db"), ("worker", "X", "m"), ("worker", None, "m"), ("unavailable", None, "t")],
        "error_kind string, error_code string, error_message string",
    )
    got = {(r.caller_code, r.caller_message) for r in errors.for_callers(df).collect()}
    assert got == {
        ("CONFIG_ERROR", "database worker rejected the call: no db"),
        ("DATABASE_WORKER_UNAVAILABLE", "database call failed: m"),
        ("DATABASE_WORKER_UNAVAILABLE", "t"),
    }


@pytest.mark.parametrize(
    ("response", "expected"),
    [
        ('{"committed":true}', (None, None, None)),
        ("{}", (None, None, None)),
        ('{"committed":false}', ("worker", "transaction rolled back", None)),
        ('{"committed":false,"failed_index":3}', ("worker", "transaction rolled back", 3)),
        ('{"committed":false,"failed_index":3,"error":{"message":"m","failed_index":1}}', ("worker", "m", 1)),
        ('{"committed":false,"failed_index":3,"error":{"inner_code":"5"}}', ("worker", "transaction rolled back (SQLSTATE 5)", 3)),
    ],
)
def test_rollbacks(spark, response, expected):
    row = errors.rollbacks(spark.createDataFrame([(response,)], "response string")).first()
    assert (row.error_kind, row.error_message, row.failed_index) == expected


def test_statement_index(spark):
    cases = [(0, 1, 5, None), (1, 1, 5, 0), (3, 1, 5, 2), (4, 1, 5, None), (0, 0, 3, 0), (2, 0, 3, None), (None, 0, 3, None)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, f bigint, o bigint, n bigint")
    rows = df.select("i", errors.statement_index(F.col("f"), F.col("o"), F.col("n")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [c[3] for c in cases]


def test_wire_row(spark):
    df = spark.sql(
        "SELECT 9007199254740993L AS big, 1 AS small, CAST(1.50 AS DECIMAL(9,2)) AS dec, DATE '2024-02-29' AS d, "
        "TIMESTAMP_NTZ '2024-02-29 01:02:03' AS t, X'00FF' AS b, array(1L, NULL) AS xs, CAST(NULL AS STRING) AS n, true AS ok"
    )
    assert df.select(wire_row(df.schema).alias("r")).first().r == (
        '{"big":"9007199254740993","small":1,"dec":"1.50","d":"2024-02-29","t":"2024-02-29T01:02:03.000000Z",'
        '"b":"AP8=","xs":["1",null],"n":null,"ok":true}'
    )


def test_wire_row_with_json_kept_as_text(spark):
    rows = [(1, '{"a": [1, null, "x"]}'), (2, "7"), (3, 'not "json"'), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "i int, `j.s` string")
    got = [r.w for r in df.orderBy("i").select(wire_row(df.schema, ["j.s"]).alias("w")).collect()]
    assert [json.loads(w)["j.s"] for w in got] == [{"a": [1, None, "x"]}, 7, 'not "json"', None, ""]


def test_wire_row_reaches_into_structs_and_maps(spark):
    df = spark.sql(
        "SELECT named_struct('big', 9007199254740993L, 'a.b', map('k', named_struct('d', CAST(1.10 AS DECIMAL(4,2))))) AS deep, "
        "CAST(NULL AS STRUCT<x: BIGINT>) AS none, array(named_struct('t', DATE '2024-02-29')) AS xs, TIME '01:02:03' AS `cl.oc``k`"
    )
    assert df.select(wire_row(df.schema).alias("r")).first().r == (
        '{"deep":{"big":"9007199254740993","a.b":{"k":{"d":"1.10"}}},"none":null,"xs":[{"t":"2024-02-29"}],"cl.oc`k":"01:02:03"}'
    )
