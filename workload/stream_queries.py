"""The streaming jobs, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import errors as er
from tidemark.session import fresh_dir
from tidemark.sources import scripts as sc
from tidemark.streaming import attempts as sa, drift, outcomes as so, sinks
from workload import inputs as ip
from workload.registry import Source, duck, query, with_
from workload.script_queries import _OUTCOMES, _files, _tries

DELAY = "60 days"


def _stream(s, table: str, recipe: str) -> DataFrame:
    """A recipe over one table read as a file stream: one file, or a folder of files.

    The path is a pattern, as a stream takes a plain path for a folder.
    """
    rows = s.spark.readStream.schema(s.table(table).schema).parquet(f"{s.sf_dir}/{table}.parque[t]")
    view = f"arriving_{table}"
    rows.createOrReplaceTempView(view)
    return s.spark.sql(getattr(ip, recipe)(ip.SparkDialect(lambda _: view)))


def _run(s, stream: DataFrame, sink) -> DataFrame:
    base = fresh_dir(s.spark, "streams")
    out = f"{base}/out"
    sink(stream, out, f"{base}/progress").awaitTermination()
    return s.spark.read.parquet(out)


@query(
    "stream_drift",
    _files("""
    SELECT g.db_id, g.name, g.checksum, l.checksum AS applied_checksum,
      CASE WHEN l.name IS NULL THEN 'pending' WHEN l.checksum = g.checksum THEN 'applied' ELSE 'mismatched' END AS state
    FROM good g LEFT JOIN ledger l ON g.db_id = l.db_id AND g.name = l.name"""),
)
def stream_drift(s):
    arriving = sc.valid(sc.scan(_stream(s, "documents", "scripts")))

    def watch(stream, out, progress):
        return drift.monitor(stream, lambda session: Source(session, s.sf_dir).ledger(), out, progress)

    return _run(s, arriving, watch).drop("batch")


@query("stream_applied_once", _tries("SELECT DISTINCT db_id, name FROM attempts WHERE ok"))
def stream_applied_once(s):
    """The delay covers the whole span of the events, so no row comes late."""
    keys = sa.applied_once(_stream(s, "events", "attempts"), DELAY)
    return _run(s, keys, sinks.append_files)


@query(
    "stream_failures",
    with_(
        """
    SELECT db_id, code, strftime(hour_start, '%Y-%m-%d %H:%M:%S') AS hour_start, failures
    FROM (SELECT db_id, code, time_bucket(INTERVAL '1' HOUR, attempted_at) AS hour_start, count(*) AS failures
      FROM attempts WHERE NOT ok GROUP BY 1, 2, 3) w
    WHERE hour_start + INTERVAL '1' HOUR <= (SELECT max(attempted_at) FROM attempts WHERE NOT ok) - INTERVAL '1' HOUR""",
        attempts=duck("attempts"),
    ),
)
def stream_failures(s):
    """Hours still open at the end are not emitted."""
    counts = sa.failures_by_hour(_stream(s, "events", "attempts"), "1 hour")
    return _run(s, counts, sinks.append_files).withColumn(
        "hour_start", F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss")
    )


# An attempt is judged once the watermark has passed it: the latest one less the delay.
_CLOSED = "ended_at <= (SELECT max(ended_at) FROM attempts) - INTERVAL '1' HOUR"
def _judged(s):
    spark = s.spark
    name, value = so.STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        arriving = er.normalise(_stream(s, "events", "attempts")).withColumn("kind", F.col("error_kind"))
        return _run(s, so.outcomes(arriving, "1 hour"), sinks.append_files)
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


@query(
    "stream_outcomes",
    _tries(f"SELECT event_id, db_id, name, outcome FROM outcomes WHERE {_CLOSED}", outcomes=_OUTCOMES),
)
def stream_outcomes(s):
    """The batch result of ``attempt_outcome`` for all attempts that are closed."""
    return _judged(s).select("event_id", "db_id", "name", "outcome")


@query(
    "stream_conflicts",
    _tries(
        f"""SELECT event_id, db_id, name, checksum, first_checksum, strftime(first_ok_at, '%Y-%m-%d %H:%M:%S.%f') AS first_ok_at
    FROM outcomes WHERE ok AND checksum <> first_checksum AND {_CLOSED}""",
        outcomes=_OUTCOMES,
    ),
)
def stream_conflicts(s):
    rows = _judged(s).where("conflict").select("event_id", "db_id", "name", "checksum", "first_checksum", "first_ok_at")
    return rows.withColumn("first_ok_at", F.date_format("first_ok_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
