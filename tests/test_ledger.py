"""Scripts against ledgers, runs, attempts, sources and the user-level calls."""

import hashlib
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import runs, status as st
from tidemark.plans import calls
from tidemark.sources import files as fl, ledger as ledgers, schemas, scripts as sc

NOW = "2026-07-23 08:00:00"
AT = datetime(2026, 1, 1)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def files(spark, rows):
    return spark.createDataFrame([(d, n, bytearray(c.encode())) for d, n, c in rows], "db_id string, name string, content binary")


def ledger(spark, rows):
    return spark.createDataFrame([(d, n, c, AT) for d, n, c in rows], schemas.LEDGER)


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


FILES = [
    ("a", "20260101000000_one.sql", "SELECT 1;\n"),
    ("a", "20260102000000_two.sql", "SELECT 2;\r\n"),
    ("a", "20260103000000_three.sql", "SELECT 3;"),
    ("a", "20260104000000_four.sql", "'open"),
    ("b", "20260101000000_one.sql", "SELECT 1;"),
    ("b", "notes.sql", "x"),
    ("c", "20270101000000_later.sql", "SELECT 1;"),
    ("c", "20260101000000_ok.sql", "-- nothing"),
]
LEDGER = [
    ("a", "20260101000000_one.sql", sha("SELECT 1;\n")),
    ("a", "20260102000000_two.sql", sha("SELECT 2;\n")),
    ("a", "20250101000000_gone.sql", "x"),
    ("c", "20260101000000_ok.sql", "drifted"),
]


def test_status(spark):
    got = calls.status(files(spark, FILES), ledger(spark, LEDGER), NOW)
    assert pairs(got["states"], "db_id", "name", "state") == {
        ("a", "20260101000000_one.sql", "applied"),
        ("a", "20260102000000_two.sql", "applied"),  # CRLF is no drift
        ("a", "20260103000000_three.sql", "pending"),
        ("a", "20260104000000_four.sql", "pending"),
        ("a", "20250101000000_gone.sql", "missing"),
        ("c", "20270101000000_later.sql", "pending"),
        ("c", "20260101000000_ok.sql", "mismatched"),
    }
    assert pairs(got["errors"], "db_id", "file") == {("b", "notes.sql")}
    assert pairs(got["future_dated"], "db_id", "name", "applied") == {("c", "20270101000000_later.sql", False)}


def test_up(spark):
    got = calls.up(files(spark, FILES), ledger(spark, LEDGER), NOW)
    assert pairs(got["plan"], "db_id", "name", "state", "statements") == {
        ("a", "20260103000000_three.sql", "applied", 1),
        ("a", "20260104000000_four.sql", "failed", 0),
    }
    assert pairs(got["blocked"], "db_id", "name") == {("c", "20260101000000_ok.sql")}
    assert pairs(got["errors"], "db_id", "file") == {("b", "notes.sql")}


def test_check(spark):
    dbs = spark.createDataFrame([("a",), ("b",), ("c",), ("empty",)], "db_id string")
    readable = spark.createDataFrame([("a",), ("b",)], "db_id string")
    got = calls.check(files(spark, FILES), ledger(spark, LEDGER), dbs, readable, NOW)
    assert pairs(got["pending"], "db_id", "name", "ok", "statements") == {
        ("a", "20260103000000_three.sql", True, 1),
        ("a", "20260104000000_four.sql", False, 0),
        ("b", "20260101000000_one.sql", True, 1),
        ("c", "20260101000000_ok.sql", False, 0),  # no ledger known: every script
        ("c", "20270101000000_later.sql", True, 1),
    }
    assert pairs(got["invalid"], "db_id", "file") == {("b", "notes.sql")}
    assert pairs(got["drift"], "name", "state") == {("20250101000000_gone.sql", "missing")}
    assert pairs(got["future_dated"], "name", "applied") == {("20270101000000_later.sql", False)}
    assert pairs(got["summary"], "db_id", "ok", "db_checked", "invalid_names", "pending", "pending_bad", "mismatched", "missing", "future_dated") == {
        ("a", False, True, 0, 2, 1, 0, 1, 0),
        ("b", False, True, 1, 1, 0, 0, 0, 0),
        ("c", False, False, 0, 2, 1, 0, 0, 1),
        ("empty", True, False, 0, 0, 0, 0, 0, 0),
    }


BROKEN = [*LEDGER, ("a", "20260103000000_three.sql", None), ("d", None, "x")]


def test_broken_ledger_rows_are_errors(spark):
    """No call guesses what a row without name or checksum stands for."""
    more = [*FILES, ("d", "20260101000000_d.sql", "SELECT 1;")]
    errors = {("a", "ledger row without checksum"), ("d", "ledger row without name")}
    got = calls.status(files(spark, more), ledger(spark, BROKEN), NOW)
    assert pairs(got["errors"], "db_id", "reason") >= errors
    assert {r.db_id for r in got["states"].collect()} == {"c"}
    got = calls.up(files(spark, more), ledger(spark, BROKEN), NOW)
    assert pairs(got["errors"], "db_id", "reason") >= errors and got["plan"].count() == 0
    got = calls.baseline(files(spark, more), ledger(spark, BROKEN), NOW)
    assert pairs(got["errors"], "db_id", "reason") >= errors
    assert "a" not in {r.db_id for r in got["plan"].collect()}
    dbs = spark.createDataFrame([("a",), ("d",), ("e",)], "db_id string")
    got = calls.check(files(spark, more), ledger(spark, BROKEN), dbs, dbs, NOW)
    assert pairs(got["summary"], "db_id", "ok", "db_checked", "reason") == {
        ("a", False, False, "ledger row without checksum"),
        ("d", False, False, "ledger row without name"),
        ("e", True, True, None),
    }


def test_up_warns_of_future_dates_and_splits_pending_scripts_only(spark):
    sound = [r for r in LEDGER if r[0] == "a"]
    got = calls.up(files(spark, FILES), ledger(spark, sound), NOW)
    assert pairs(got["future_dated"], "name", "applied") == {("20270101000000_later.sql", False)}
    recorded = spark.createDataFrame([(f[0], f[1]) for f in FILES if "three" not in f[1]], "db_id string, name string")
    judged = sc.scan(files(spark, FILES), verdicts=True, recorded=recorded)
    assert {r.name for r in judged.where("ok is not null and checksum is not null").collect()} == {"20260103000000_three.sql"}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # contents stay in the scan stage


def test_more_recorded_scripts_than_travel_are_all_split(spark, monkeypatch):
    monkeypatch.setattr(sc, "FEW_SCRIPTS", 1)
    recorded = spark.createDataFrame([(f[0], f[1]) for f in FILES], "db_id string, name string")
    judged = sc.scan(files(spark, FILES), verdicts=True, recorded=recorded)
    assert "Join" not in judged._jdf.queryExecution().executedPlan().toString()
    assert judged.where("ok is null").count() == 0
    plain = calls.up(files(spark, FILES), ledger(spark, [r for r in LEDGER if r[0] == "a"]), NOW)["plan"]
    monkeypatch.undo()
    again = calls.up(files(spark, FILES), ledger(spark, [r for r in LEDGER if r[0] == "a"]), NOW)["plan"]
    assert sorted(plain.collect()) == sorted(again.collect())


def test_names_that_spark_hides(spark, tmp_path):
    """Their databases are refused, whatever the folder is called."""
    for db, name in [("a b", "_x.sql"), ("a b", "20260101000000_x.sql"), ("c%20+d", ".y.sql"), ("é", "20260101000000_z.sql"), ("é", ".hidden.md")]:
        (tmp_path / f"db_id={db}").mkdir(exist_ok=True)
        (tmp_path / f"db_id={db}" / name).write_bytes(b"SELECT 1;")
    with open(os.fsencode(str(tmp_path / "db_id=é")) + b"/.\xff.sql", "wb"):
        pass
    found = sc.read_scripts(spark, str(tmp_path))
    got = calls.status(found, ledger(spark, []), NOW)
    assert pairs(got["errors"], "db_id", "file") == {("a b", "_x.sql"), ("c%20+d", ".y.sql"), ("é", ".\ufffd.sql")}
    assert got["states"].count() == 0


def test_files_are_written_once(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [("a b", "1.sql", b"\xff\x00"), ("a b", "_2.sql", b""), ("c", "3.md", b"x")]
    df = spark.createDataFrame(rows, "db_id string, name string, content binary")
    fl.write_files(df.repartition(2), root)
    fl.write_files(df, root)  # the same bytes again are no clash
    read = fl.read_files(spark, root, pages="3")
    assert sorted((r.db_id, r.name, bytes(r.content)) for r in read.collect()) == sorted(rows)
    assert read.where("name like '%.sql'").count() == 2
    assert fl.read_files(spark, root, suffix=".sql", hidden="true", content="false").collect()[0].content is None
    assert [r.db_id for r in fl.read_files(spark, root, at="3.md").collect()] == ["c"]
    assert fl.read_files(spark, str(tmp_path / "none")).count() == 0
    other = spark.createDataFrame([("c", "3.md", b"y")], "db_id string, name string, content binary")
    with pytest.raises(Exception, match="FileExistsError|File exists"):
        fl.write_files(other, root)
    with pytest.raises(Exception, match="no file name"):
        fl.write_files(other.withColumn("name", F.lit("../x")), root)
    assert not any("." in n and len(n) > 30 for n in os.listdir(root + "/db_id=c"))


def test_pins_go_with_their_scope(spark):
    from tidemark.session import pin, pins, shared_dir

    with pins(spark):
        kept = pin(spark.range(3))
        assert kept.count() == 3 and kept.inputFiles()
        folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://"))
        assert os.path.isdir(folder) and shared_dir(spark)
    assert not os.path.exists(folder)


def test_pending_plan_places(spark):
    got = st.pending_plan(sc.valid(sc.scan(files(spark, FILES))), ledger(spark, LEDGER))
    assert pairs(got, "db_id", "name", "pos") == {
        ("a", "20260103000000_three.sql", 0),
        ("a", "20260104000000_four.sql", 1),
        ("b", "20260101000000_one.sql", 0),
        ("c", "20270101000000_later.sql", 0),
    }


def test_baseline(spark):
    some = [f for f in FILES if f[0] == "a"]
    got = calls.baseline(files(spark, some), ledger(spark, LEDGER), NOW)
    assert pairs(got["plan"], "name", "action") == {
        ("20260101000000_one.sql", "skip"),
        ("20260102000000_two.sql", "skip"),
        ("20260103000000_three.sql", "insert"),
        ("20260104000000_four.sql", "insert"),
    }
    bad = ledger(spark, [*LEDGER, ("a", "20260103000000_three.sql", "other")])
    got = calls.baseline(files(spark, some), bad, NOW)
    assert got["inserts"].count() == 0
    assert pairs(got["plan"], "name", "action") >= {("20260104000000_four.sql", "void"), ("20260103000000_three.sql", "mismatch")}


def test_baseline_names(spark):
    some = files(spark, [f for f in FILES if f[0] == "a"])
    wanted = spark.createDataFrame([("a", "20260104000000_four.sql")] * 2, "db_id string, name string")
    got = calls.baseline(some, ledger(spark, []), NOW, wanted)
    assert pairs(got["inserts"], "name") == {("20260104000000_four.sql",)} and got["inserts"].count() == 1
    unknown = wanted.unionByName(spark.createDataFrame([("a", "nope.sql")], "db_id string, name string"))
    got = calls.baseline(some, ledger(spark, []), NOW, unknown)
    assert pairs(got["unknown"], "name") == {("nope.sql",)} and got["inserts"].count() == 0


def test_baseline_outcome(spark):
    cols = "db_id string, name string, checksum string"
    inserts = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x"), ("b", "2", "y"), ("c", "1", "x")], cols)
    after = ledger(spark, [("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x"), ("b", "2", "z")])
    assert pairs(st.baseline_outcome(inserts, after), "db_id", "outcome", "first_name") == {
        ("a", "skipped", None), ("b", "mismatch", "2"), ("c", "failed", "1"),
    }


def test_run_replay_stops_at_the_first_failure(spark):
    plan = spark.createDataFrame(
        [("a", "1", True), ("a", "2", False), ("a", "3", True), ("a", "4", False), ("b", "1", True)],
        "db_id string, name string, ok boolean",
    )
    assert pairs(runs.run_replay(plan), "db_id", "name", "state") == {
        ("a", "1", "applied"), ("a", "2", "failed"), ("a", "3", "not_attempted"), ("a", "4", "not_attempted"), ("b", "1", "applied"),
    }


def attempts(spark, rows):
    at = lambda s: AT + timedelta(seconds=s)
    return spark.createDataFrame(
        [("a", rep, name, chk, ok, kind, None, None, at(a), at(e)) for rep, name, chk, ok, kind, a, e in rows], schemas.ATTEMPTS
    )


def test_attempts(spark):
    tries = attempts(spark, [
        (0, "1", "x", True, None, 0, 5),
        (1, "1", "x", False, "worker", 1, 6),  # another replica applied it meanwhile
        (2, "1", "y", False, "worker", 1, 6),  # with other content
        (3, "1", "x", False, "worker", 1, 4),  # ended before that
        (4, "1", "x", False, "unavailable", 1, 9),
        (0, "2", "x", False, "worker", 6, 7),
    ])
    out = runs.attempt_outcome(tries)
    assert pairs(out, "replica", "name", "outcome") == {
        (0, "1", "applied"), (1, "1", "skipped"), (2, "1", "mismatch"), (3, "1", "failed"), (4, "1", "unavailable"), (0, "2", "failed"),
    }
    summary = runs.run_summary(out, ledger(spark, [("a", "0", "x"), ("a", "00", "x")]))
    assert pairs(summary, "replica", "applied", "skipped", "duration_ms") == {
        (0, 1, 2, 7000), (1, 0, 3, 5000), (2, 0, 2, 5000), (3, 0, 2, 3000), (4, 0, 2, 8000),
    }


def test_double_applied(spark):
    tries = attempts(spark, [(0, "1", "x", True, None, 0, 5), (1, "1", "x", True, None, 0, 6), (0, "2", "x", True, None, 0, 1)])
    assert pairs(runs.double_applied(tries), "name", "times_applied") == {("1", 2)}


def test_script_folder(spark, tmp_path):
    for db, name, content in [
        ("a", "20260101000000_x.sql", b"SELECT 1;\r\n"), ("a", "README.md", b"no"), ("a", "20260102000000_y.SQL", b"no"),
        ("b", "notes.sql", b"\xff"), ("b", "20260101000000_bytes.sql", b"\xff;"),
    ]:
        (tmp_path / f"db_id={db}").mkdir(exist_ok=True)
        (tmp_path / f"db_id={db}" / name).write_bytes(content)
    nested = tmp_path / "db_id=a" / "deeper.sql"
    nested.mkdir()
    (nested / "20260101000000_z.sql").write_bytes(b"no")

    found = sc.read_scripts(spark, str(tmp_path))
    scanned = sc.scan(found)
    assert pairs(sc.valid(scanned), "db_id", "name", "checksum") == {
        ("a", "20260101000000_x.sql", sha("SELECT 1;\n")),
        ("b", "20260101000000_bytes.sql", hashlib.sha256(b"\xff;").hexdigest()),
    }
    assert pairs(sc.invalid(scanned), "db_id", "file", "reason") == {("b", "notes.sql", "name too short")}
    # The content is not read unless it is needed.
    plan = found.select("name")._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan and "content" not in plan.split("binaryFile")[1].split("\n")[0].split("ReadSchema")[-1]


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledgers.read_ledger(spark, path).count() == 0
    rows = sc.valid(sc.scan(files(spark, FILES)))
    ledgers.append(ledgers.new_rows(ledgers.read_ledger(spark, path), rows, NOW), path, "r1")
    assert ledgers.read_ledger(spark, path).count() == rows.count()
    again = ledgers.new_rows(ledgers.read_ledger(spark, path), rows, NOW)
    assert again.count() == 0  # a second run finds nothing to add


def test_appends_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = ledgers.new_rows(ledgers.read_ledger(spark, path), sc.valid(sc.scan(files(spark, FILES))), NOW)
    both = [ledgers.new_rows(ledgers.read_ledger(spark, path), r, NOW) for r in (rows, rows.where("db_id <> 'c'").withColumn("checksum", F.lit("other")))]
    ledgers.append(both[0], path, "run 1")
    ledgers.append(both[0], path, "run 1")  # sent twice
    assert ledgers.read_ledger(spark, path).count() == rows.count() == spark.read.parquet(path).count()
    ledgers.append(both[1], path, "run 0")  # another run that had seen the empty ledger too
    got = ledgers.read_ledger(spark, path)
    assert got.count() == rows.count() and got.select("db_id", "name").distinct().count() == rows.count()
    assert {r.checksum == "other" for r in got.where("db_id = 'a'").collect()} == {True}  # the least run's
    assert pairs(ledgers.recorded_twice(spark, path).withColumn("runs", F.array_join("runs", ",")), "runs", "agree") == {("run 0,run 1", False)}
    assert sorted(got.columns) == ["applied_at", "checksum", "db_id", "name"]


def test_broken_ledger_rows(spark):
    rows = spark.createDataFrame([("a", None, "x", AT), ("a", "n", None, AT), ("a", "n", "x", AT)], schemas.LEDGER)
    assert ledgers.sound(rows).count() == 1
    assert pairs(ledgers.broken(rows), "missing_field") == {("name",), ("checksum",)}


def test_written_files_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(fl, "WRITTEN", 2)
    one = spark.createDataFrame([("a", f"{k}.sql", b"x") for k in range(5)], "db_id string, name string, content binary").coalesce(1)
    assert fl.dealt(one).rdd.getNumPartitions() == 3 and fl.dealt(one).count() == 5
    assert fl.dealt(one.limit(0)).count() == 0
