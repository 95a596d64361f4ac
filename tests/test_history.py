"""Rising sequences against a loop, and another tool's history."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import history, keyed
from tidemark.plans import calls
from tidemark.sources import journal as jn, schemas


def loop(values, floor):
    out = []
    for v in values:
        floor = max(v, floor + 1)
        out.append(floor)
    return out


def test_rising_equals_the_loop(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for db in range(6):
        size = 4000 if db == 0 else rng.randint(1, 60)  # one history holds most rows
        values = [rng.choice([rng.randint(-50, 50), rng.randint(0, 5000)]) for _ in range(size)]
        floor = rng.randint(-20, 20)
        expected[db] = loop(values, floor)
        rows += [(db, i, v, floor) for i, v in enumerate(values)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "db int, i int, v bigint, f bigint").repartition(7)
    got = keyed.rising(df, ["db"], ["i"], "v", F.col("f"), "s").collect()
    assert len(got) == len(rows)
    assert all(expected[r.db][r.i] == r.s for r in got)


def test_placed(spark):
    rng = random.Random(5)
    rows = [(db, f"{n:06d}") for db, size in enumerate([3000, 1, 17]) for n in rng.sample(range(100000), size)]
    rng.shuffle(rows)
    got = keyed.placed(spark.createDataFrame(rows, "db int, name string"), ["db"], ["name"]).collect()
    for db in range(3):
        mine = sorted((r for r in got if r.db == db), key=lambda r: r.pos)
        assert [r.name for r in mine] == sorted(n for d, n in rows if d == db)
        assert [r.pos for r in mine] == list(range(len(mine)))


def test_attach_keeps_rows_whole_with_and_without_broadcast(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"))
    lookup = spark.range(0, 20000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    expected = rows.join(lookup, "k", "left").agg(F.count("*"), F.sum("v")).first()
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = keyed.attach(rows, lookup, ["k"]).agg(F.count("*"), F.sum("v")).first()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert tuple(got) == tuple(expected)


def test_a_hot_key_is_split(spark):
    """Beyond the broadcast size AQE spreads a hot key, though the lookup is grouped."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 300000, 1, 8).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"))
        lookup = spark.range(0, 300000, 2).repartition(5).groupBy(F.col("id").alias("k")).agg(F.count("*").alias("v"))
        joined, plain = keyed.attach(rows, lookup, ["k"]), rows.join(lookup, "k", "left")
        assert len(joined.collect()) == len(plain.collect()) == 300000
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (joined, plain)]
        assert ["skew=true" in p for p in plans] == [True, False]
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_names_rise_within_the_same_second(spark):
    """Half seconds round down; what is not later than its forerunner takes the next second."""
    noon = 1_600_000_200_000  # 2020-09-13 12:30:00 UTC
    rows = [("p", 5, 0, noon + 500, "0005_wide road"), ("p", 6, 0, noon + 900, "0006_hill"), ("p", 7, 0, noon - 60_000, "0007_"), ("q", 1, 0, -1, "y")]
    df = spark.createDataFrame(rows, "db_id string, idx bigint, pos int, when bigint, tag string")
    got = {r.idx: r.target_name for r in history.monotonic_names(df).collect()}
    assert got[6] == "20200913123001_hill.sql" and got[1] == "19700101000001_y.sql"
    assert got[5].startswith("20200913123000_") and got[7].startswith("20200913123002_")


def test_names_out_of_range_have_a_reason(spark):
    df = spark.createDataFrame([("a", 0, 0, 10**18, "t")], "db_id string, idx bigint, pos int, when bigint, tag string")
    row = history.monotonic_names(df).first()
    assert row.target_name is None and row.reason == names.BAD_PREFIX


def test_allocation(spark):
    scripts = spark.createDataFrame([("a", "20260101000000_x.sql"), ("a", "20260723080000_y.sql"), ("b", "20261399000000_z.sql")], "db_id string, name string")
    requests = spark.sql("""SELECT * FROM VALUES
      ('a', 1, TIMESTAMP_NTZ '2026-07-01 00:00:00', ' add_users '), ('a', 2, TIMESTAMP_NTZ '2026-07-01 00:00:00', 'bad name'),
      ('a', 3, TIMESTAMP_NTZ '2026-07-01 00:00:00', 'next'), ('a', 4, TIMESTAMP_NTZ '2026-08-01 00:00:00.9', 'later'),
      ('b', 1, TIMESTAMP_NTZ '2020-01-01 00:00:00', 'p'), ('c', 1, TIMESTAMP_NTZ '2020-01-01 00:00:00', 'q'), ('c', 2, TIMESTAMP_NTZ '2020-01-01 00:00:00', 'q')
      AS t(db_id, seq, requested_at, slug)""")
    given, refused = history.allocate_names(requests, scripts)
    assert {(r.db_id, r.seq): r.name for r in given.collect()} == {
        ("a", 1): "20260723080001_add_users.sql",
        ("a", 3): "20260723080002_next.sql",
        ("a", 4): "20260801000000_later.sql",
        ("b", 1): "20200101000000_p.sql",
        ("c", 1): "20200101000000_q.sql",
        ("c", 2): "20200101000001_q.sql",
    }
    assert [(r.db_id, r.seq) for r in refused.collect()] == [("a", 2)]


JOURNAL = {
    "version": "7",
    "dialect": "pg",
    "entries": [
        {"idx": i, "version": "7", "when": 1_650_000_000_000 + 3_600_000 * i + 7 * i, "tag": f"{i:04d}_{word}", "breakpoints": False}
        for i, word in ((1, "roof"), (2, "door"), (0, "wall"))
    ],
}


def test_journal_files(spark, tmp_path):
    folder = tmp_path / "db_id=a b"
    folder.mkdir()
    (folder / "meta").mkdir()
    (folder / "meta" / "_journal.json").write_text(json.dumps(JOURNAL, indent=2))
    (tmp_path / "db_id=none").mkdir()
    journals = jn.read_journals(spark, str(tmp_path))
    assert [(r.db_id, r.dialect) for r in journals.collect()] == [("a b", "pg")]
    rows = jn.entries(journals).orderBy("place").collect()
    assert [r.tag for r in rows] == ["0000_wall", "0001_roof", "0002_door"]


def test_ties_in_a_journal_keep_file_order(spark):
    df = spark.createDataFrame(
        [("a", [(1, 5, "b"), (0, 5, "z"), (1, 5, "a")])], "db_id string, entries array<struct<idx: bigint, when: bigint, tag: string>>"
    )
    assert [r.tag for r in jn.entries(df).orderBy("place").collect()] == ["z", "b", "a"]


def test_source_checks_come_in_order(spark):
    cols = "db_id string, dialect string, entries array<struct<idx: bigint, when: bigint, tag: string>>"
    one = [(0, 1, "t0"), (1, 1, "t1")]
    journals = spark.createDataFrame([("mysql", "mysql", []), ("empty", "pg", []), ("other", "libsql", one), ("lost", "pg", one), ("fine", "turso", one), ("absent", "pg", one)], cols)
    dialects = spark.createDataFrame([("mysql", "postgres"), ("empty", "sqlite"), ("other", "postgres"), ("lost", "postgres"), ("fine", "sqlite")], "db_id string, dialect string")
    files = spark.createDataFrame([("fine", "t0"), ("fine", "t1"), ("lost", "t0")], "db_id string, tag string")
    got = {r.db_id: r.reason for r in history.adopt_source_check(journals, jn.entries(journals), dialects, files).collect()}
    assert got == {
        "mysql": "unsupported dialect mysql",
        "empty": "the journal has no entries",
        "other": "journal dialect is sqlite but the target database is postgres",
        "lost": "journal entry `t1` has no file",
        "fine": None,
        "absent": "journal dialect is postgres but the target database is not configured",
    }


def test_dialects(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "db_id string")
    known = spark.createDataFrame([("a", "postgres"), ("b", "mysql"), ("d", None)], schemas.DATABASES)
    assert {(r.db_id, r.outcome, r.dialect) for r in jn.dialects(wanted, known).collect()} == {
        ("a", "ok", "postgres"), ("b", "unsupported", None), ("c", "not_configured", None), ("d", "unsupported", None),
    }


def test_matches(spark):
    items = spark.createDataFrame(
        [("a", "0000_a", 1000, "a.sql", "hash-a"), ("a", "0001_b", 2000, "b.sql", "hash-b"), ("a", "0002_c", 3000, "c.sql", "hash-c")],
        "db_id string, tag string, when bigint, target_name string, raw_hash string",
    )
    rows = spark.createDataFrame([("a", "hash-a", "1000"), ("a", "OTHER", "2000"), ("a", "zz", "2000"), ("a", None, "x"), ("b", "h", "3000")], schemas.FOREIGN_LEDGER)
    foreign = jn.foreign_rows(rows)
    assert {(r.hash, r.created_at) for r in foreign.collect()} >= {("", 0)}
    got = {(r.tag, r.state, r.drifted, r.recorded_hash) for r in history.adopt_match(items, foreign).collect()}
    assert got == {("0000_a", "applied", False, "hash-a"), ("0001_b", "applied", True, "OTHER"), ("0002_c", "pending", False, None)}
    assert {r.state for r in history.adopt_match(items, foreign, "all").collect()} == {"applied"}
    assert {r.state for r in history.adopt_match(items, foreign, "none").collect()} == {"pending"}


def test_adopt_end_to_end(spark):
    """Database x is taken over; y has other content under a name, z an entry without a name,
    v a broken ledger row: none of the three gets states or inserts."""

    def sha(b):
        return hashlib.sha256(b).hexdigest()

    texts = {"0000_wall": b"CREATE TABLE wall (h int);\r\n", "0001_roof": b"CREATE TABLE roof (w int);", "0002_door": b"DROP TABLE roof;"}
    when = {e["tag"]: e["when"] for e in JOURNAL["entries"]}
    entries = [(e["idx"], e["when"], e["tag"]) for e in JOURNAL["entries"]]
    late = [(0, 10**18, "0000_wall"), *[e for e in entries if e[0]]]
    shape = "db_id string, dialect string, entries array<struct<idx: bigint, when: bigint, tag: string>>"
    journals = spark.createDataFrame([(d, "pg", late if d == "z" else entries) for d in "vxyz"], shape)
    source = spark.createDataFrame([(d, t, bytearray(c)) for d in "vxyz" for t, c in texts.items()], "db_id string, tag string, content binary")
    foreign = spark.createDataFrame(
        [(d, h, str(when[t])) for d in "vxyz" for t, h in (("0000_wall", sha(texts["0000_wall"])), ("0001_roof", "older"))], schemas.FOREIGN_LEDGER
    )
    dialects = spark.createDataFrame([(d, "postgres") for d in "vxyz"], "db_id string, dialect string")
    first, second, third = "20220415052000_wall.sql", "20220415062000_roof.sql", "20220415072000_door.sql"
    here = spark.createDataFrame(
        [("x", first, bytearray(b"CREATE TABLE wall (h int);\n")), ("y", third, bytearray(b"SELECT 1;"))], "db_id string, name string, content binary"
    )
    ledger = spark.createDataFrame([("v", "20200101000000_v.sql", None, None)], schemas.LEDGER)
    now = "2026-01-01 00:00:00"
    got = calls.adopt(journals, source, foreign, here, ledger, dialects, now)
    assert {r.db_id for r in got["refused"].collect()} == {"v", "y", "z"}
    assert {(r.db_id, r.tag) for r in got["unnamed"].collect()} >= {("z", "0000_wall")}
    assert {(r.target_name, r.decision) for r in got["imports"].where("db_id = 'x'").collect()} == {(first, "skip"), (second, "write"), (third, "write")}
    assert {(r.db_id, r.tag, r.state, r.drifted) for r in got["states"].collect()} == {
        ("x", "0000_wall", "applied", False), ("x", "0001_roof", "applied", True), ("x", "0002_door", "pending", False),
    }
    inserts = got["inserts"].collect()
    assert {(r.db_id, r.name, r.checksum) for r in inserts} == {
        ("x", first, sha(b"CREATE TABLE wall (h int);\n")), ("x", second, sha(texts["0001_roof"])),
    }
    # A second call finds everything recorded.
    again = calls.adopt(journals, source, foreign, here, spark.createDataFrame(inserts, schemas.LEDGER), dialects, now)
    assert again["inserts"].where("db_id = 'x'").count() == 0


def test_names_past_the_last_second_are_refused(spark):
    scripts = spark.createDataFrame([("a", "99991231235959_x.sql")], "db_id string, name string")
    requests = spark.sql("SELECT 'a' AS db_id, 1 AS seq, TIMESTAMP_NTZ '2026-07-01 00:00:00' AS requested_at, 'more' AS slug")
    given, refused = history.allocate_names(requests, scripts)
    assert given.count() == 0
    assert [(r.seq, r.slug, r.reason) for r in refused.collect()] == [(1, "more", names.BAD_PREFIX)]


def test_foreign_ledger_files(spark, tmp_path):
    """No such ledger means a fresh database."""
    assert jn.read_foreign(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("k", "h", "17"), ("k", None, "soon")], schemas.FOREIGN_LEDGER)
    rows.write.parquet(str(tmp_path / "there"))
    got = jn.foreign_rows(jn.read_foreign(spark, str(tmp_path / "there")))
    assert {(r.hash, r.created_at) for r in got.collect()} == {("h", 17), ("", 0)}
