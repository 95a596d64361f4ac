"""Rising names, requested names and another tool's history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import history
from tidemark.plans import calls
from tidemark.sources import journal as jn, scripts as sc
from workload.inputs import NOW
from workload.registry import duck, query, with_
from workload.script_queries import _files

SLUG = "regexp_replace(regexp_replace(tag, '^[0-9]+_', ''), '[^A-Za-z0-9_-]', '_', 'g')"
_RISING = f"""
  SELECT db_id, idx, tag, raw_hash, `when`, second,
    strftime(make_timestamp(second * 1000000), '%Y%m%d%H%M%S') || '_' || {SLUG} || '.sql' AS target_name
  FROM (SELECT *, i + greatest(1, max(`when` // 1000 - i) OVER (PARTITION BY db_id ORDER BY idx)) AS second
    FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY idx) - 1 AS i FROM journal) a) b"""


@query("monotonic_names", with_("SELECT db_id, idx, second, target_name FROM rising", journal=duck("journal", True), rising=_RISING))
def monotonic_names(s):
    return history.monotonic_names(s.journal(True)).select("db_id", "idx", "second", "target_name")


@query("sparse_names", with_("SELECT db_id, idx, second, target_name FROM rising", journal=duck("journal", False), rising=_RISING))
def sparse_names(s):
    return history.monotonic_names(s.journal(False)).select("db_id", "idx", "second", "target_name")


_ALLOCATED = """
  SELECT db_id, seq, strftime(make_timestamp(second * 1000000), '%Y%m%d%H%M%S') || '_' || slug || '.sql' AS name, NULL AS refused
  FROM (SELECT db_id, seq, slug, i + greatest(latest + 1, max(sec - i) OVER (PARTITION BY db_id ORDER BY seq)) AS second
    FROM (SELECT r.*, l.latest, row_number() OVER (PARTITION BY r.db_id ORDER BY seq) - 1 AS i
      FROM clean r JOIN latest l ON r.db_id = l.db_id WHERE slug IS NOT NULL) a) b
  UNION ALL SELECT db_id, seq, NULL, raw FROM clean WHERE slug IS NULL"""
_REQUESTS = {
    "requests": duck("name_requests"),
    "clean": """SELECT db_id, seq, slug AS raw, epoch_us(requested_at) // 1000000 AS sec,
      CASE WHEN regexp_full_match(trim(slug), '[A-Za-z0-9_-]+') THEN trim(slug) END AS slug FROM requests""",
    "latest": """SELECT db_id, max(epoch_us(try_strptime(substr(name, 1, 14), '%Y%m%d%H%M%S')) // 1000000) AS latest
      FROM good GROUP BY db_id""",
}


@query("allocate_names", _files(_ALLOCATED, **_REQUESTS))
def allocate_names(s):
    given, refused = history.allocate_names(s.name_requests(), sc.valid(sc.scan(s.scripts())))
    none = F.lit(None).cast("string")
    return given.withColumn("refused", none).unionByName(
        refused.select("db_id", "seq", none.alias("name"), F.col("slug").alias("refused"))
    )


_BAD_REQUEST = names.BAD_REQUEST.replace("'", "''").replace("`", "' || chr(96) || '")


@query(
    "create_call",
    _files(
        f"SELECT db_id, seq, name, CASE WHEN name IS NULL THEN '{_BAD_REQUEST}' END AS reason FROM ({_ALLOCATED}) x",
        **_REQUESTS,
    ),
)
def create_call(s):
    got = calls.create(s.name_requests(), s.scripts())
    none = F.lit(None).cast("string")
    return got["names"].withColumn("reason", none).unionByName(
        got["refused"].select("db_id", "seq", none.alias("name"), "reason")
    )


# Every document is read as a journal: its lines are the entries.
_LINES = """
  SELECT doc_id, CAST(doc_id AS STRING) AS db_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, lang FROM documents"""
_ENTRIES = """
  SELECT doc_id, db_id, lang, line, length(line) % 7 AS idx, pos, pos || '_w' || length(line) AS tag,
    (doc_id * 1000 + pos) * 1000 AS `when`,
    row_number() OVER (PARTITION BY doc_id ORDER BY length(line) % 7, pos) - 1 AS place FROM lines"""
_ALIASES = "CASE lang WHEN 'en' THEN 'pg' WHEN 'de' THEN 'postgresql' WHEN 'fr' THEN 'turso' ELSE 'mysql' END"
_TARGETS = "CASE WHEN doc_id % 10 = 0 THEN 'sqlite' WHEN doc_id % 10 = 1 THEN NULL WHEN lang = 'fr' THEN 'sqlite' ELSE 'postgres' END"


def _lines(s):
    number = F.col("doc_id")
    entry = lambda x, i: F.struct(
        (F.char_length(x) % 7).cast("bigint").alias("idx"),
        ((number * 1000 + i) * 1000).alias("when"),
        F.concat(i.cast("string"), F.lit("_w"), F.char_length(x).cast("string")).alias("tag"),
    )
    docs = s.table("documents").where(F.col("text").isNotNull())
    return docs.select(
        number.cast("string").alias("db_id"),
        F.expr(_ALIASES).alias("dialect"),
        F.expr(_TARGETS).alias("target"),
        F.transform(F.split("text", "\n"), entry).alias("entries"),
    )


@query(
    "journal_entries",
    with_(
        f"""SELECT db_id, place, idx, pos, tag, `when`,
          CASE WHEN lang IN ('en', 'de') THEN 'postgres' WHEN lang = 'fr' THEN 'sqlite' END AS dialect FROM entries""",
        lines=_LINES,
        entries=_ENTRIES,
    ),
)
def journal_entries(s):
    rows = jn.entries(_lines(s), carry=["dialect"])
    return rows.select(
        "db_id",
        F.col("place").cast("bigint").alias("place"),
        "idx",
        F.col("pos").cast("bigint").alias("pos"),
        "tag",
        "when",
        jn.dialect_of(F.col("dialect")).alias("dialect"),
    )


@query(
    "adopt_source_check",
    with_(
        f"""
    SELECT j.db_id, CASE WHEN source IS NULL THEN 'unsupported dialect ' || alias
      WHEN n = 0 THEN 'the journal has no entries'
      WHEN source IS DISTINCT FROM target THEN 'journal dialect is ' || source || ' but the target database is ' || coalesce(target, 'not configured')
      WHEN absent IS NOT NULL THEN 'journal entry ' || chr(96) || absent || chr(96) || ' has no file' END AS reason
    FROM (SELECT doc_id, CAST(doc_id AS STRING) AS db_id, {_ALIASES} AS alias, {_TARGETS} AS target,
        CASE WHEN lang IN ('en', 'de') THEN 'postgres' WHEN lang = 'fr' THEN 'sqlite' END AS source FROM documents) j
    JOIN (SELECT doc_id, count(*) AS n, arg_min(tag, place) FILTER (length(line) % 61 = 60) AS absent
      FROM entries GROUP BY doc_id) e ON j.doc_id = e.doc_id""",
        lines=_LINES,
        entries=_ENTRIES,
    ),
)
def adopt_source_check(s):
    """Lines of certain lengths have lost their file."""
    journals = _lines(s)
    entries = jn.entries(journals)
    length = F.regexp_extract("tag", "_w([0-9]+)$", 1).cast("bigint")
    files = entries.where(length % 61 != 60).select("db_id", "tag")
    targets = journals.select("db_id", F.col("target").alias("dialect"))
    return history.adopt_source_check(journals, entries, targets, files)


@query(
    "adopt_match",
    with_(
        """
    SELECT j.idx, j.db_id, CASE WHEN f.recorded IS NULL THEN 'pending' ELSE 'applied' END AS state,
      f.recorded AS recorded_hash, coalesce(f.recorded <> j.raw_hash, false) AS drifted
    FROM journal j LEFT JOIN (
      SELECT db_id, coalesce(try_cast(created_at AS BIGINT), 0) AS created, min(coalesce(hash, '')) AS recorded
      FROM foreign_rows GROUP BY 1, 2) f ON j.db_id = f.db_id AND j.`when` = f.created""",
        journal=duck("journal", False),
        foreign_rows=duck("foreign_ledger"),
    ),
)
def adopt_match(s):
    items = s.journal(False).withColumn("target_name", F.concat("tag", F.lit(".sql")))
    foreign = jn.foreign_rows(s.foreign_ledger())
    return history.adopt_match(items, foreign).select("idx", "db_id", "state", "recorded_hash", "drifted")


# Journals that can be taken over, with the names their entries get.
_NAMED = f"""
  SELECT *, strftime(make_timestamp(second * 1000000), '%Y%m%d%H%M%S') || '_w' || length(line) || '.sql' AS target_name
  FROM (SELECT *, place + greatest(1, max(`when` // 1000 - place) OVER (PARTITION BY doc_id ORDER BY place)) AS second FROM entries
    WHERE lang <> 'es' AND ({_TARGETS}) IS NOT DISTINCT FROM CASE WHEN lang = 'fr' THEN 'sqlite' ELSE 'postgres' END
      AND doc_id NOT IN (SELECT doc_id FROM lines WHERE length(line) % 61 = 60)) e"""
_STATES = """
  SELECT e.*, f.hash IS NOT NULL AS applied, coalesce(f.hash <> sha256(e.line), false) AS drifted
  FROM named e LEFT JOIN (SELECT doc_id, `when`, CASE WHEN length(line) % 5 = 0 THEN 'old' ELSE sha256(line) END AS hash
    FROM entries WHERE pos % 3 = 0) f ON e.doc_id = f.doc_id AND e.`when` = f.`when`
  WHERE e.doc_id % 7 <> 0"""


def _adopted(tail: str) -> str:
    return with_(tail, lines=_LINES, entries=_ENTRIES, named=_NAMED, states=_STATES)


def _adopt(s):
    """Every document taken over as a journal whose scripts are its lines.

    The first name of a document is there already in every seventh database with other
    content, in the next one with the same, and recorded in every fifth.
    """
    journals = _lines(s)
    docs = s.table("documents").select(F.col("doc_id").cast("string").alias("db_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    length = F.char_length("line")
    tag = F.concat(F.col("pos").cast("string"), F.lit("_w"), length.cast("string"))
    source = docs.where(length % 61 != 60).select("db_id", tag.alias("tag"), F.encode("line", "UTF-8").alias("content"))
    number = F.col("db_id").cast("bigint")
    when = (number * 1000 + F.col("pos")) * 1000
    recorded = F.when(length % 5 == 0, "old").otherwise(F.sha2("line", 256))
    foreign = docs.where(F.col("pos") % 3 == 0).select("db_id", recorded.alias("hash"), when.cast("string").alias("created_at"))
    first = docs.groupBy("db_id").agg(F.min(F.struct((length % 7).alias("idx"), "pos", "line")).alias("f"))
    stamp = F.date_format(F.timestamp_seconds(F.greatest(F.lit(1), number * 1000 + F.col("f.pos"))), "yyyyMMddHHmmss")
    name = F.concat(stamp, F.lit("_w"), F.char_length("f.line").cast("string"), F.lit(".sql"))
    content = F.when(number % 7 == 0, "other").otherwise(F.col("f.line"))
    here = first.where(number % 7 < 2).select("db_id", name.alias("name"), F.encode(content, "UTF-8").alias("content"))
    ledger = first.where(number % 5 == 0).select(
        "db_id", name.alias("name"), F.sha2("f.line", 256).alias("checksum"), F.lit(NOW).cast("timestamp_ntz").alias("applied_at")
    )
    targets = journals.select("db_id", F.col("target").alias("dialect"))
    return calls.adopt(journals, source, foreign, here, ledger, targets, NOW)


@query(
    "adopt_plan",
    _adopted("SELECT db_id, tag, target_name, CASE WHEN applied THEN 'applied' ELSE 'pending' END AS state, drifted FROM states"),
)
def adopt_plan(s):
    return _adopt(s)["states"].select("db_id", "tag", "target_name", "state", "drifted")


@query(
    "adopt_imports",
    _adopted("""
    SELECT db_id, target_name, sha256(line) AS checksum, CASE WHEN place > 0 OR doc_id % 7 > 1 THEN 'write'
      WHEN doc_id % 7 = 1 THEN 'skip' ELSE 'conflict' END AS decision FROM named"""),
)
def adopt_imports(s):
    return _adopt(s)["imports"].select("db_id", "target_name", "checksum", "decision")


@query(
    "adopt_inserts",
    _adopted("""
    SELECT db_id, target_name AS name, sha256(line) AS said FROM states WHERE applied AND NOT (place = 0 AND doc_id % 5 = 0)
    UNION ALL SELECT db_id, NULL, 'other content is there as ' || chr(96) || target_name || chr(96) FROM named WHERE place = 0 AND doc_id % 7 = 0"""),
)
def adopt_inserts(s):
    """The rows to record, and the databases refused because of a clash of names."""
    got = _adopt(s)
    clash = got["refused"].where(F.startswith("reason", F.lit("other content")))
    return got["inserts"].select("db_id", "name", F.col("checksum").alias("said")).unionByName(
        clash.select("db_id", F.lit(None).cast("string").alias("name"), F.col("reason").alias("said"))
    )


@query(
    "import_decision",
    _files("""
    SELECT i.db_id, i.name AS target_name, i.checksum, g.checksum AS existing_checksum,
      CASE WHEN g.name IS NULL THEN 'write' WHEN g.checksum = i.checksum THEN 'skip' ELSE 'conflict' END AS decision
    FROM ledger i LEFT JOIN good g ON i.db_id = g.db_id AND i.name = g.name"""),
)
def import_decision(s):
    """The ledger's rows taken as the scripts to import."""
    items = s.ledger().select("db_id", F.col("name").alias("target_name"), "checksum")
    return history.import_decision(items, sc.valid(sc.scan(s.scripts())))


@query(
    "dialect_lookup",
    """SELECT CAST(c_custkey AS STRING) AS db_id,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'not_configured' WHEN c_mktsegment = 'MACHINERY' THEN 'unsupported' ELSE 'ok' END AS outcome,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL WHEN c_nationkey % 2 = 0 THEN 'postgres' ELSE 'sqlite' END AS dialect
    FROM customer""",
)
def dialect_lookup(s):
    """Market segments stand in for databases nobody configured or nobody can handle."""
    customers = s.table("customer")
    key = F.col("c_custkey").cast("string").alias("db_id")
    driver = F.when(F.col("c_mktsegment") == "MACHINERY", "mysql").when(
        F.col("c_nationkey") % 2 == 0, "postgres"
    ).otherwise("sqlite")
    configured = customers.where(F.col("c_mktsegment") != "BUILDING").select(key, driver.alias("driver"))
    return jn.dialects(customers.select(key), configured)
