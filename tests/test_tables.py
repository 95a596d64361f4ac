"""Table changes, constraint checks and streams."""

from datetime import datetime

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import constraints as con, evolve as ev, keyed
from tidemark.session import fresh_dir
from tidemark.sources import schemas
from tidemark.sources.ledger import read_ledger
from tidemark.streaming import attempts as sa, drift, outcomes as so, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_change_types_reports_what_does_not_fit(spark):
    df = spark.createDataFrame(
        [(1, 9999.99, "7", 2.0), (2, 10000.0, "x", 3e9), (3, None, None, float("nan")), (4, 9999.995, "-1", -2147483648.9), (5, -9999.994, " 5 ", 2147483647.5)],
        "i int, amount double, text string, big double",
    )
    got = ev.change_types(df, {"amount": "decimal(6,2)", "text": "int", "big": "int"})
    plain = df.select("i", *[F.col(c).try_cast(t).alias(c) for c, t in [("amount", "decimal(6,2)"), ("text", "int"), ("big", "int")]])
    assert rows(got.drop("rejected")) == rows(plain)  # same as casting outright
    rejected = {r.i: r.rejected for r in got.collect()}
    assert rejected[1] == [] and rejected[2] == ["amount", "text", "big"] and rejected[3] == ["big"]
    kept, lost = ev.split_rejects(got)
    assert kept.count() + lost.count() == 5 and "rejected" not in kept.columns


def test_reshaping(spark):
    df = spark.createDataFrame([(1, "a", 2.5)], "id int, name string, score double")
    assert rows(ev.add_column(df, "n", "bigint", 0)) == [(1, "a", 2.5, 0)]
    assert ev.rename_columns(df, {"id": "key"}).columns == ["key", "name", "score"]
    assert ev.drop_columns(df, "score").columns == ["id", "name"]
    shaped = ev.recreate(df, [("score", "decimal(5,2)", None), ("label", "string", F.upper("name")), ("id", "bigint", None)])
    assert shaped.columns == ["score", "label", "id"] and [f.dataType.simpleString() for f in shaped.schema] == ["decimal(5,2)", "string", "bigint"]


def test_swap(spark, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    spark.range(3).write.parquet(old)
    spark.sql(f"CREATE TABLE swapped (id BIGINT) USING parquet LOCATION '{old}'")
    try:
        ev.publish(spark.range(5), new)
        ev.swap_location(spark, "swapped", new)
        assert spark.table("swapped").count() == 5
    finally:
        spark.sql("DROP TABLE swapped")


def test_copy_verify(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, "b")], "i int, x string, y string")
    cols = df.columns

    def verdict(copy):
        return ev.copy_verify(df, copy, cols).first().matches

    assert verdict(df.select("y", "x", "i").repartition(3))
    assert not verdict(df.distinct())
    assert not verdict(df.distinct().unionByName(df.where("i = 2")))
    assert not verdict(df.select("i", F.col("y").alias("x"), F.col("x").alias("y")))  # a value moved to another column
    empty = df.limit(0)
    assert ev.copy_verify(empty, empty, cols).first().matches


def test_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3), (None, 3)], "a int, b int")
    assert rows(con.primary_key_violations(df, ["a", "b"])) == rows(spark.createDataFrame([(1, 1, 2), (None, 3, 2)], "a int, b int, n bigint"))
    assert rows(con.unique_violations(df, ["a", "b"])) == [(1, 1, 2)]
    parent = spark.createDataFrame([(1, 2)], "x int, y int")
    assert rows(con.foreign_key_violations(df, ["a", "b"], parent, ["x", "y"])) == [(1, 1, 2)]
    assert rows(con.null_counts(df, ["a", "b"])) == [("a", 2), ("b", 0)]
    labels = spark.createDataFrame([("1",)], "label string")
    assert rows(con.enum_violations(df.select(F.col("b").cast("string")), "b", labels)) == [("2", 1), ("3", 2)]


def test_delete_actions(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "pid int, v string")
    gone = spark.createDataFrame([(1,), (7,)], "id int")
    assert rows(con.after_delete(child, ["pid"], gone, ["id"], "CASCADE")) == rows(child.where("pid = 2 OR pid IS NULL"))
    assert rows(con.after_delete(child, ["pid"], gone, ["id"], "SET NULL")) == sorted([(None, "a"), (2, "b"), (None, "c")], key=repr)


def test_deletes_follow_all_keys(spark):
    key = con.ForeignKey
    people = spark.createDataFrame([(1, None, 9), (2, 1, 9), (3, 2, None), (4, 4, 9), (5, 6, 1), (6, 5, 1), (7, None, 9)], "id int, boss int, `_hash` int")
    teams = spark.createDataFrame([(10, 1, 3, "a"), (11, 7, 2, "b"), (12, 7, 7, "c"), (13, None, 5, "d")], "`t.id` int, lead int, deputy int, _gone0 string")
    logs = spark.createDataFrame([(100, 10, 1), (101, 11, 3), (102, 12, None)], "n int, `t.id` int, who int")
    tables = {"people": people, "teams": teams, "logs": logs}
    keys = [
        key("people", ("boss",), "people", ("id",), "CASCADE"),
        key("teams", ("lead",), "people", ("id",), "CASCADE"),
        key("teams", ("deputy",), "people", ("id",), "SET NULL"),
        key("logs", ("t.id",), "teams", ("t.id",), "CASCADE"),
        key("logs", ("who",), "people", ("id",), "RESTRICT"),
    ]
    after, refused = con.delete_rows(tables, keys, {"people": spark.createDataFrame([(1,), (5,)], "id int")})
    # 1 takes 2 and 3 along, 5 and 6 are a cycle, and team 10 falls with its lead.
    assert rows(after["people"]) == [(4, 4, 9), (7, None, 9)] and after["people"].columns == people.columns
    assert rows(after["teams"]) == sorted([(11, 7, None, "b"), (12, 7, 7, "c"), (13, None, None, "d")], key=repr)
    assert rows(after["logs"]) == sorted([(101, 11, 3), (102, 12, None)], key=repr)
    assert rows(refused) == [("logs", ["who"], "people", 1)]
    same, none = con.delete_rows(tables, keys, {"people": spark.createDataFrame([(99,)], "id int")})
    assert all(rows(same[t]) == rows(tables[t]) for t in tables) and none.count() == 0
    pair = spark.createDataFrame([(1, 2, 3), (1, None, 3), (2, 2, 3)], "a int, b int, c int")
    two = [key("pair", ("a", "b"), "pair", ("b", "c"), "SET NULL"), key("pair", ("c",), "pair", ("a",), "CASCADE")]
    left, _ = con.delete_rows({"pair": pair}, two, {"pair": spark.createDataFrame([(2, 2)], "a int, b int")})
    assert rows(left["pair"]) == sorted([(1, 2, 3), (1, None, 3)], key=repr)


def test_own_column_names_are_kept(spark):
    df = spark.createDataFrame([(1, "x", 2, 3, 4, "7"), (2, "y", 5, 6, 7, "z")], "a int, _new_a string, _hash int, _gone int, `p.q` int, _new string")
    got = ev.change_types(df, {"a": "string", "_new": "int"})
    assert rows(got) == sorted([("1", "x", 2, 3, 4, 7, []), ("2", "y", 5, 6, 7, None, ["_new"])], key=repr)
    gone = spark.createDataFrame([(4,)], "`p.q` int")
    assert rows(con.after_delete(df, ["p.q"], gone, ["p.q"], "CASCADE")) == [tuple(r) for r in df.where("a = 2").collect()]
    assert {(r["p.q"], r["_gone"]) for r in con.after_delete(df, ["p.q"], gone, ["p.q"], "SET NULL").collect()} == {(None, 3), (7, 6)}
    assert rows(con.foreign_key_violations(df, ["p.q"], gone, ["p.q"])) == [(7, 1)]
    assert rows(con.enum_violations(df.withColumn("p.q", F.lit("on")), "p.q", spark.createDataFrame([("off",)], "label string"))) == [("on", 2)]
    moved = df.withColumn("_hash", F.col("_hash") + 1)
    assert {r.op for r in con.audit_changes(df, moved, ["p.q"]).collect()} == {"UPDATE"}
    assert con.primary_key_violations(df, ["p.q", "a"]).count() == 0
    own = spark.createDataFrame([(1, "k", 5, 9, 9, 9, 9), (2, "k", 5, 8, 8, 8, 8)], "i int, `d.b` string, v bigint, _at int, _chunk int, _row int, _hash int")
    placed = keyed.placed(own, ["d.b"], ["i"])
    assert placed.columns == [*own.columns, "pos"] and [r.pos for r in placed.orderBy("i").collect()] == [0, 1]
    rising = keyed.rising(own, ["d.b"], ["i"], "v", F.lit(0), "s")
    assert rising.columns == [*own.columns, "s"] and [r.s for r in rising.orderBy("i").collect()] == [5, 6]


def test_declared_rules_in_one_pass(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (1, 1, "a", None), (None, 2, "b", "y"), (3, 3, None, "z"), (4, 4, None, "x")], "id int, `n.o` int, code string, kind string")
    report = Row(
        primary_key=["id"],
        indexes=[Row(index_name="by_code", is_unique=True, columns=["code", "n.o"], definition=None), Row(index_name="part", is_unique=True, columns=["code"], definition="CREATE UNIQUE INDEX part ON t (code) WHERE id > 1"), Row(index_name="plain", is_unique=False, columns=["kind"], definition=None)],
        columns=[Row(column_name=c, nullable=n, data_type=t) for c, n, t in [("id", False, "int"), ("n.o", False, "int"), ("code", False, "text"), ("kind", True, "mark")]],
    )
    rules = con.declared(report, {"mark": ["x", "y"]})
    assert [(r.kind, r.name) for r in rules] == [("primary key", "primary key"), ("unique", "by_code"), ("not null", "n.o"), ("not null", "code"), ("enum", "kind")]
    got = con.declared_violations(df, rules)
    assert rows(got) == sorted([
        ("primary key", "primary key", '{"id":1}', 2), ("primary key", "primary key", '{"id":null}', 1), ("unique", "by_code", '{"code":"a","n.o":1}', 2),
        ("not null", "code", '{"code":null}', 2), ("enum", "kind", '{"kind":"z"}', 1),
    ], key=repr)
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    assert con.declared_violations(df, []).count() == 0


def test_copy_differences(spark):
    df = spark.createDataFrame([(i, f"v{i}", None if i % 3 else i, i % 5) for i in range(60)], "k int, x string, y int, _sign int")
    copy = df.where("k <> 7").withColumn("x", F.when(F.col("k") == 9, "other").otherwise(F.col("x")))
    copy = copy.unionByName(df.where("k = 11")).unionByName(df.where("k = 12").withColumn("k", F.lit(None).cast("int")))
    got = rows(ev.copy_differences(df, copy, ["k"], df.columns, buckets=16))
    assert got == sorted([(7, "missing"), (9, "different"), (11, "different"), (None, "extra")], key=repr)
    assert ev.copy_differences(df, df.repartition(3), ["k"], df.columns).count() == 0
    assert ev.copy_differences(df.limit(0), df.limit(0), ["k"], df.columns).count() == 0


def test_audit(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, x string, y int")
    after = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", 1)], "k int, x string, y int")
    got = {(r.k, r.op) for r in con.audit_changes(before, after, ["k"]).collect()}
    assert got == {(2, "UPDATE"), (3, "DELETE"), (4, "INSERT")}


def test_drift_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, base = str(tmp_path / "in"), fresh_dir(spark, "tests")
    ledger = str(tmp_path / "ledger")
    spark.createDataFrame([("a", "1", "x", None), ("a", "2", "y", None)], schemas.LEDGER).write.parquet(ledger)
    cols = "db_id string, name string, checksum string"

    def run():
        stream = spark.readStream.schema(cols).parquet(src)
        watch = drift.monitor(stream, lambda session: read_ledger(session, ledger), f"{base}/out", f"{base}/progress")
        watch.awaitTermination()
        return {(r.name, r.state) for r in spark.read.parquet(f"{base}/out").collect()}

    spark.createDataFrame([("a", "1", "x"), ("a", "2", "z")], cols).write.mode("append").parquet(src)
    assert run() == {("1", "applied"), ("2", "mismatched")}
    spark.createDataFrame([("a", "3", "x")], cols).write.mode("append").parquet(src)
    assert run() == {("1", "applied"), ("2", "mismatched"), ("3", "pending")}
    assert run() == {("1", "applied"), ("2", "mismatched"), ("3", "pending")}
    # What was recorded meanwhile counts for the next versions.
    spark.createDataFrame([("a", "4", "x", None)], schemas.LEDGER).write.mode("append").parquet(ledger)
    spark.createDataFrame([("a", "4", "x")], cols).write.mode("append").parquet(src)
    assert run() >= {("4", "applied")}


def test_applied_once_across_batches(spark, tmp_path):
    src, base = str(tmp_path / "in"), fresh_dir(spark, "tests")
    cols = "db_id string, name string, ok boolean, code string, attempted_at timestamp"

    def run(*values):
        spark.createDataFrame(values, cols).withColumn("attempted_at", F.to_timestamp(F.lit("2024-01-01"))).write.mode("append").parquet(src)
        stream = sa.applied_once(spark.readStream.schema(cols).parquet(src), "1 day")
        sinks.append_files(stream, f"{base}/out", f"{base}/progress").awaitTermination()
        return sorted(r.name for r in spark.read.parquet(f"{base}/out").collect())

    assert run(("a", "1", True, None, None), ("a", "1", True, None, None), ("a", "2", False, "c", None)) == ["1"]
    assert run(("a", "1", True, None, None), ("a", "2", True, None, None)) == ["1", "2"]


def test_outcomes_across_batches_and_restarts(spark, tmp_path):
    """Attempts that arrive out of order are judged in the order in which they ended."""
    src, base = str(tmp_path / "in"), fresh_dir(spark, "tests")
    cols = "event_id bigint, db_id string, name string, ok boolean, kind string, checksum string, ended_at timestamp"

    def run(*values):
        spark.createDataFrame([(*v[:6], datetime(2024, 1, 1, v[6])) for v in values], cols).write.mode("append").parquet(src)
        spark.conf.set(*so.STATE_STORE)
        try:
            stream = so.outcomes(spark.readStream.schema(cols).parquet(src), "2 hours", "10 hours")
            sinks.append_files(stream, f"{base}/out", f"{base}/progress").awaitTermination()
        finally:
            spark.conf.unset(so.STATE_STORE[0])
        return {(r.event_id, r.outcome, r.conflict, r.first_checksum) for r in spark.read.schema(so.OUTCOMES).parquet(f"{base}/out").collect()}

    first = run((1, "a", "s", False, "worker", "x", 1), (2, "a", "s", True, None, "y", 3), (3, "a", "s", False, "worker", "y", 4), (9, "b", "t", True, None, "x", 5))
    assert first == {(1, "failed", False, None)} | {(2, "applied", False, "y")}
    # One that ended before those still waiting, and a second success with another checksum.
    second = run((4, "a", "s", True, None, "z", 4), (5, "a", "s", False, "unavailable", "y", 5), (6, "b", "t", False, "worker", "q", 9))
    assert second - first == {(3, "skipped", False, "y"), (4, "applied", True, "y"), (5, "unavailable", False, "y"), (9, "applied", False, "x")}
    # Long after, the first success is forgotten.
    third = run((7, "a", "s", True, None, "z", 20), (8, "c", "u", False, "worker", "q", 23))
    assert third - second == {(6, "mismatch", False, "x"), (7, "applied", False, "z")}


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, None), (1, "x")], "`a.b` int, `c``d` string")
    assert {(r.column_name, r.n_nulls) for r in con.null_counts(df, ["a.b", "c`d"]).collect()} == {("a.b", 0), ("c`d", 1)}
    assert con.unique_violations(df, ["a.b"]).count() == 1
    assert ev.copy_verify(df, df, ["a.b", "c`d"]).first()["matches"]
    assert ev.change_types(df, {"a.b": "string"}).columns == ["a.b", "c`d", "rejected"]


def test_attempts_of_one_arrival_need_one_timer():
    """Every timer is a call of its own, so a key holds one, whatever the number of its attempts."""
    class Value:
        def __init__(self):
            self.held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = put = lambda self, x: setattr(self, "held", x)
        appendList = lambda self, x: setattr(self, "held", (self.held or []) + x)

    class Handle:
        def __init__(self):
            self.timers = []
        getValueState = getListState = lambda self, *_: Value()
        registerTimer = lambda self, at: self.timers.append(at)
        deleteTimer = lambda self, at: self.timers.remove(at)

    judge, handle = so.Judge(1000), Handle()
    judge.init(handle)
    def arrive(*seconds):
        at = pd.to_datetime([datetime(2024, 1, 1, 0, 0, s) for s in seconds])
        list(judge.handleInputRows(("a", "s"), iter([pd.DataFrame({"event_id": 1, "ended_at": at, "ok": True, "kind": None, "checksum": "x"})]), None))
    arrive(*range(10, 60))
    first = list(handle.timers)
    arrive(5, 20)
    assert len(first) == 1 and handle.timers == [first[0] - 5000]
    arrive(30)
    assert handle.timers == [first[0] - 5000]
