"""Scripts, ledgers, runs and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import errors as er
from tidemark.functions import names, statements
from tidemark.functions.hashing import checksum, raw_checksum
from tidemark.functions.text import pascal_case
from tidemark.operators import runs, status as st
from tidemark.plans import calls
from tidemark.session import fresh_dir, pin
from tidemark.sources import files as fl, ledger as ledgers, scripts as sc
from workload import inputs as ip
from workload.inputs import NOW
from workload.inputs import attempts as attempts_sql
from workload.registry import duck, query, with_

# Oracle texts ---------------------------------------------------------------------------

REASON = """CASE
  WHEN name NOT LIKE '%.sql' THEN 'missing .sql extension'
  WHEN strlen(name) < 18 THEN 'name too short'
  WHEN NOT regexp_matches(name, '^[0-9]{14}') THEN 'prefix must be a 14-digit timestamp (YYYYMMDDHHMMSS)'
  WHEN name[15] <> '_' THEN 'timestamp must be followed by `_slug`'
  WHEN length(name) = 19 THEN 'slug must not be empty'
  WHEN NOT regexp_full_match(name[16:length(name) - 4], '[A-Za-z0-9_-]+') THEN 'slug may only contain [A-Za-z0-9_-]'
  END"""
# The backticks above are part of a message; ``duck`` would turn them into quotes.
REASON = REASON.replace("`_slug`", "' || chr(96) || '_slug' || chr(96) || '")
INSTANT = (
    "CASE WHEN regexp_matches(name, '^[0-9]{14}') "
    "THEN try_strptime(substr(name, 1, 14), '%Y%m%d%H%M%S') END"
)
UNIX = "sha256(replace(content, chr(13) || chr(10), chr(10)))"
FUTURE = f"coalesce({INSTANT} > TIMESTAMP '{NOW}' + INTERVAL '5' MINUTE, false)"
SCAN = f"""
  SELECT *, CASE WHEN reason IS NULL THEN {UNIX} END AS checksum FROM (
    SELECT *, {REASON} AS reason FROM scripts WHERE name LIKE '%.sql' AND name <> '.sql') s"""
GOOD = "SELECT db_id, doc_id, name, content, checksum FROM scan WHERE reason IS NULL"
STATUS = """
  SELECT coalesce(g.db_id, l.db_id) AS db_id, coalesce(g.name, l.name) AS name,
    CASE WHEN l.name IS NULL THEN 'pending' WHEN g.name IS NULL THEN 'missing'
      WHEN g.checksum = l.checksum THEN 'applied' ELSE 'mismatched' END AS state,
    g.checksum AS file_checksum, l.checksum AS applied_checksum,
    strftime(l.applied_at, '%Y-%m-%d %H:%M:%S.%f') AS applied_at
  FROM good g FULL JOIN ledger l ON g.db_id = l.db_id AND g.name = l.name"""


def _files(tail: str, **more: str) -> str:
    return with_(
        tail, scripts=duck("scripts"), ledger=duck("ledger"), scan=SCAN, good=GOOD, status=STATUS, **more
    )


def _good(s):
    return sc.valid(sc.scan(s.scripts()))


# Names and hashes -----------------------------------------------------------------------


@query("name_validation", _files(f"SELECT db_id, name, {REASON} AS reason FROM scripts"))
def name_validation(s):
    return s.scripts().select("db_id", "name", names.invalid_reason(F.col("name")).alias("reason"))


@query(
    "name_timestamp",
    _files(f"SELECT db_id, name, strftime({INSTANT}, '%Y-%m-%d %H:%M:%S') AS at FROM scripts"),
)
def name_timestamp(s):
    at = names.instant(F.col("name"))
    return s.scripts().select("db_id", "name", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    "future_dated",
    _files(f"""
    SELECT g.db_id, g.name, l.name IS NOT NULL AS applied,
      CASE WHEN l.name IS NOT NULL THEN '{st.HINT_APPLIED}' ELSE '{st.HINT_PENDING}' END AS hint
    FROM (SELECT * FROM good WHERE {FUTURE}) g
    LEFT JOIN ledger l ON g.db_id = l.db_id AND g.name = l.name"""),
)
def future_dated(s):
    return st.future_dated(_good(s), s.ledger(), NOW)


@query(
    "script_checksum",
    _files(f"SELECT db_id, name, {UNIX} AS checksum, sha256(content) AS raw_checksum FROM scripts"),
)
def script_checksum(s):
    content = F.col("content")
    return s.scripts().select(
        "db_id", "name", checksum(content).alias("checksum"), raw_checksum(content).alias("raw_checksum")
    )


@query(
    "tag_slug",
    """SELECT page_id, CASE WHEN slug = '' THEN 'migration' ELSE slug END AS slug FROM (
      SELECT page_id, regexp_replace(regexp_replace(tag, '^[0-9]+_', ''), '[^A-Za-z0-9_-]', '_', 'g') AS slug
      FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN page_id || '_'
        ELSE page_id || '_' || url END AS tag FROM pages) t) s""",
)
def tag_slug(s):
    number = F.col("page_id").cast("string")
    tag = (
        F.when(F.col("page_id") % 4 == 0, F.col("url"))
        .when(F.col("page_id") % 4 == 1, F.concat(number, F.lit("_")))
        .otherwise(F.concat(number, F.lit("_"), "url"))
    )
    return s.table("pages").select("page_id", names.tag_slug(tag).alias("slug"))


@query(
    "pascal_case",
    """SELECT p_partkey, array_to_string(list_transform(list_filter(
        string_split_regex('_' || p_name || '-' || lower(p_type) || '__' || p_brand, '[_ -]'), lambda w: w <> ''),
        lambda w: upper(w[1]) || w[2:]), '') AS title FROM part""",
)
def pascal(s):
    text = F.concat(F.lit("_"), "p_name", F.lit("-"), F.lower("p_type"), F.lit("__"), "p_brand")
    return s.table("part").select("p_partkey", pascal_case(text).alias("title"))


# Scan and status ------------------------------------------------------------------------


@query(
    "scan_strict",
    _files("""
    SELECT s.db_id, s.name, s.checksum, NULL AS error FROM scan s
    WHERE s.db_id NOT IN (SELECT db_id FROM scan WHERE reason IS NOT NULL)
    UNION ALL
    SELECT db_id, min(name), NULL, arg_min(reason, name) FROM scan WHERE reason IS NOT NULL GROUP BY db_id"""),
)
def scan_strict(s):
    good, errors = sc.scan_strict(sc.scan(s.scripts()))
    none = F.lit(None).cast("string")
    return good.select("db_id", "name", "checksum", none.alias("error")).unionByName(
        errors.select("db_id", F.col("file").alias("name"), none.alias("checksum"), F.col("reason").alias("error"))
    )


@query("ledger_status", _files("SELECT * FROM status"))
def ledger_status(s):
    rows = st.ledger_status(_good(s), s.ledger())
    return rows.withColumn("applied_at", F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "checksum_gate",
    _files("""
    SELECT db_id, name, applied_checksum, file_checksum,
      name = min(name) OVER (PARTITION BY db_id) AS blocks
    FROM status WHERE state = 'mismatched'"""),
)
def checksum_gate(s):
    gate = pin(st.checksum_gate(_good(s), s.ledger()))
    first = st.blocked(gate).select("db_id", "name", F.lit(True).alias("blocks"))
    return gate.join(first, ["db_id", "name"], "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(False))
    )


@query(
    "pending_plan",
    _files("""
    SELECT db_id, name, file_checksum AS checksum,
      row_number() OVER (PARTITION BY db_id ORDER BY name) - 1 AS pos
    FROM status WHERE state = 'pending'"""),
)
def pending_plan(s):
    return st.pending_plan(_good(s), s.ledger())


@query("ledger_check", _files("SELECT * FROM status WHERE state IN ('missing', 'mismatched')"))
def ledger_check(s):
    rows = st.ledger_check(_good(s), s.ledger())
    return rows.withColumn("applied_at", F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "ledger_append",
    _files(f"""
    SELECT db_id, name, file_checksum AS checksum, '{NOW}.000000' AS applied_at
    FROM status WHERE state = 'pending'"""),
)
def ledger_append(s):
    """Written twice under one run and read again."""
    path = f"{fresh_dir(s.spark, 'ledgers')}/ledger"
    rows = pin(ledgers.new_rows(ledgers.sound(s.ledger()), _good(s), NOW))
    ledgers.append(rows, path, "first")
    ledgers.append(rows, path, "first")
    rows = ledgers.read_ledger(s.spark, path)
    return rows.withColumn("applied_at", F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


BASELINE = """
  SELECT db_id, name, checksum, applied_checksum, stopped_by,
    CASE WHEN action = 'insert' AND stopped_by IS NOT NULL THEN 'void' ELSE action END AS action
  FROM (SELECT *, min(CASE WHEN action = 'mismatch' THEN name END) OVER (PARTITION BY db_id) AS stopped_by
    FROM (SELECT g.db_id, g.name, g.checksum, l.checksum AS applied_checksum,
        CASE WHEN l.name IS NULL THEN 'insert' WHEN l.checksum = g.checksum THEN 'skip' ELSE 'mismatch' END AS action
      FROM good g LEFT JOIN ledger l ON g.db_id = l.db_id AND g.name = l.name
      WHERE {where}) j) k"""


@query("baseline_plan", _files(BASELINE.format(where="true")))
def baseline_plan(s):
    return st.baseline_plan(_good(s), s.ledger())


@query(
    "baseline_targets",
    _files(
        """
    SELECT db_id, name, checksum, true AS found FROM good
    WHERE (db_id, name) IN (SELECT (db_id, name) FROM requested)
    UNION ALL
    SELECT DISTINCT db_id, name, NULL, false FROM requested
    WHERE (db_id, name) NOT IN (SELECT (db_id, name) FROM good)""",
        requested=duck("requested"),
    ),
)
def baseline_targets(s):
    targets, unknown = st.baseline_targets(_good(s), s.requested())
    return targets.select("db_id", "name", "checksum", F.lit(True).alias("found")).unionByName(
        unknown.withColumn("checksum", F.lit(None).cast("string")).withColumn("found", F.lit(False))
    )


@query(
    "baseline_outcome",
    _files("""
    SELECT db_id, count(*) AS n_rows,
      coalesce(arg_min(finding, name) FILTER (finding IS NOT NULL), 'skipped') AS outcome,
      min(name) FILTER (finding IS NOT NULL) AS first_name
    FROM (SELECT g.*, CASE WHEN l.name IS NULL THEN 'failed' WHEN l.checksum <> g.checksum THEN 'mismatch' END AS finding
      FROM good g LEFT JOIN ledger l ON g.db_id = l.db_id AND g.name = l.name) j GROUP BY db_id"""),
)
def baseline_outcome(s):
    return st.baseline_outcome(_good(s), s.ledger())


@query(
    "run_replay",
    _files("""
    SELECT db_id, name, failed_name,
      CASE WHEN failed_name IS NULL OR name < failed_name THEN 'applied'
        WHEN name = failed_name THEN 'failed' ELSE 'not_attempted' END AS state
    FROM (SELECT p.db_id, p.name,
        min(CASE WHEN contains(g.content, '"') THEN p.name END) OVER (PARTITION BY p.db_id) AS failed_name
      FROM status p JOIN good g ON p.db_id = g.db_id AND p.name = g.name WHERE p.state = 'pending') r"""),
)
def run_replay(s):
    """A run in which the scripts with a quoted identifier are refused."""
    refused = s.scripts().select(
        "db_id", "name", (~F.contains(F.col("content").cast("string"), F.lit('"'))).alias("ok")
    )
    plan = st.pending(_good(s), s.ledger()).join(refused, ["db_id", "name"])
    return runs.run_replay(plan).select("db_id", "name", "state", "failed_name")


# Splitting ------------------------------------------------------------------------------

# Tokens for DuckDB's regular expressions, which know no back references: of the dollar
# quotes only $$ occurs in the tables, and comments never nest there.
_DUCK_TOKEN = (
    r"--[^\n]*|/\*(?s:.*?)\*/|/\*(?s:.*)|[eE]''(?:[^''\\]|\\(?s:.)|'''')*''|[eE]''(?s:.*)"
    r"""|''[^'']*''|''(?s:.*)|"[^"]*"|"(?s:.*)|\$\$(?s:.*?)\$\$|\$\$(?s:.*)|;"""
    r"""|[A-Za-z0-9_]+|[^;''"$/A-Za-z0-9_-]+|(?s:.)"""
)
_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160)"


def _split_ctes(corpus: str) -> dict[str, str]:
    """``corpus`` selects id, text; gives piece(id, i, t, n), failed(id, error), stmt."""
    return {
        "corpus": corpus,
        "tok": f"SELECT id, regexp_extract_all(text, '{_DUCK_TOKEN}') AS ts FROM corpus",
        "flat": "SELECT id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM tok",
        "piece": (
            "SELECT id, i, t, count(*) FILTER (t = ';') OVER (PARTITION BY id ORDER BY i) AS n FROM flat"
        ),
        "failed": r"""
          SELECT id, CASE
            WHEN starts_with(t, '/*') AND NOT contains(t[3:], '*/') THEN 'unterminated block comment'
            WHEN starts_with(t, '''') AND (length(t) < 2 OR t[-1] <> '''') THEN 'unterminated string literal'
            WHEN regexp_matches(t, '^[eE]''') AND NOT regexp_full_match(t, '[eE]''(?:[^''\\]|\\(?s:.)|'''')*''')
              THEN 'unterminated string literal'
            WHEN starts_with(t, '"') AND (length(t) < 2 OR t[-1] <> '"') THEN 'unterminated quoted identifier'
            WHEN starts_with(t, '$$') AND NOT regexp_full_match(t, '\$\$(?s:.*)\$\$') THEN 'unterminated dollar-quoted block ($$)'
            END AS error
          FROM (SELECT id, ts[-1] AS t FROM tok) l""",
        "begun": f"""
          SELECT id, n, min(i) AS first FROM piece
          WHERE t <> ';' AND NOT starts_with(t, '--') AND NOT starts_with(t, '/*')
            AND trim(t, chr(9) || chr(10) || chr(12) || chr(13) || ' ') <> '' GROUP BY id, n""",
        "stmt": f"""
          SELECT p.id, p.n, trim(string_agg(p.t, '' ORDER BY p.i), {_BLANK}) AS statement
          FROM piece p JOIN begun b ON p.id = b.id AND p.n = b.n
          WHERE p.i >= b.first AND p.t <> ';' AND p.id NOT IN (SELECT id FROM failed WHERE error IS NOT NULL)
          GROUP BY p.id, p.n""",
    }


_PAGES = _split_ctes("SELECT page_id AS id, html AS text FROM pages")


def _pages(s):
    return s.table("pages").select(
        F.lit("site").alias("db_id"), F.col("page_id").alias("name"), F.encode("html", "UTF-8").alias("content")
    )


@query(
    "statement_split",
    with_(
        """SELECT 'site' AS db_id, id AS name,
          row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS pos, statement
        FROM stmt WHERE statement <> ''""",
        **_PAGES,
    ),
)
def statement_split(s):
    return sc.statements(_pages(s)).withColumn("pos", F.col("pos").cast("bigint"))


VERDICT = """
  SELECT c.id, CASE WHEN f.error IS NOT NULL THEN '{cannot}' || f.error WHEN coalesce(k.n, 0) = 0 THEN '{none}' END AS error,
    CASE WHEN f.error IS NULL THEN coalesce(k.n, 0) ELSE 0 END AS statements
  FROM corpus c LEFT JOIN failed f ON c.id = f.id
  LEFT JOIN (SELECT id, count(*) AS n FROM stmt WHERE statement <> '' GROUP BY id) k ON c.id = k.id""".format(
    cannot=statements.CANNOT_SPLIT, none=statements.NO_STATEMENTS
)


@query(
    "script_verdict",
    with_(
        "SELECT 'site' AS db_id, id AS name, error IS NULL AS ok, statements, error FROM verdict",
        **_PAGES,
        verdict=VERDICT,
    ),
)
def script_verdict(s):
    return sc.verdicts(_pages(s))


@query(
    "check_rollup",
    _files(
        f"""
    SELECT d.db_id, coalesce(invalid_names, 0) = 0 AND pending_bad_n = 0 AND drift_n = 0 AS ok, seen AS db_checked,
      coalesce(invalid_names, 0) AS invalid_names, pending_n AS pending, pending_bad_n AS pending_bad,
      drift_n AS mismatched, missing_n AS missing, coalesce(future_dated, 0) AS future_dated
    FROM (SELECT d.db_id, r.db_id IS NOT NULL AS seen, i.invalid_names, p.future_dated,
        CASE WHEN r.db_id IS NOT NULL THEN coalesce(p.pending, 0) ELSE coalesce(p.files, 0) END AS pending_n,
        CASE WHEN r.db_id IS NOT NULL THEN coalesce(p.pending_bad, 0) ELSE coalesce(p.bad, 0) END AS pending_bad_n,
        CASE WHEN r.db_id IS NOT NULL THEN coalesce(p.drift, 0) ELSE 0 END AS drift_n,
        CASE WHEN r.db_id IS NOT NULL THEN coalesce(m.missing, 0) ELSE 0 END AS missing_n
      FROM databases d LEFT JOIN readable r ON d.db_id = r.db_id
      LEFT JOIN (SELECT db_id, count(*) AS invalid_names FROM scan WHERE reason IS NOT NULL GROUP BY db_id) i ON d.db_id = i.db_id
      LEFT JOIN (SELECT db_id, count(*) AS missing FROM status WHERE state = 'missing' GROUP BY db_id) m ON d.db_id = m.db_id
      LEFT JOIN (SELECT f.db_id, count(*) AS files, count(*) FILTER (f.error IS NOT NULL) AS bad,
          count(*) FILTER (s.state = 'pending') AS pending,
          count(*) FILTER (s.state = 'pending' AND f.error IS NOT NULL) AS pending_bad,
          count(*) FILTER (s.state = 'mismatched') AS drift, count(*) FILTER (f.future) AS future_dated
        FROM (SELECT g.db_id, g.name, v.error, {FUTURE} AS future FROM good g JOIN verdict v ON g.doc_id = v.id) f
        JOIN status s ON f.db_id = s.db_id AND f.name = s.name GROUP BY f.db_id) p ON d.db_id = p.db_id) d""",
        databases=duck("databases"),
        readable=duck("readable"),
        **_split_ctes("SELECT doc_id AS id, content AS text FROM good"),
        verdict=VERDICT,
    ),
)
def check_rollup(s):
    facts = sc.scan(s.scripts(), verdicts=True)
    return st.check_rollup(s.databases(), facts, s.ledger(), s.readable(), NOW)


@query(
    "check_pending",
    _files(
        """
    SELECT g.db_id, g.name, v.error IS NULL AS ok, v.statements, v.error FROM good g JOIN verdict v ON g.doc_id = v.id
    WHERE NOT EXISTS (SELECT 1 FROM ledger l JOIN readable r ON l.db_id = r.db_id WHERE l.db_id = g.db_id AND l.name = g.name)""",
        readable=duck("readable"),
        **_split_ctes("SELECT doc_id AS id, content AS text FROM good"),
        verdict=VERDICT,
    ),
)
def check_pending(s):
    """The scripts a run would meet; where the ledger is unknown, every script."""
    return calls.check(s.scripts(), s.ledger(), s.databases(), s.readable(), NOW)["pending"]


@query(
    "apply_plan",
    _files(
        """
    SELECT db_id, name, checksum, statements, error, failed_name,
      CASE WHEN failed_name IS NULL OR name < failed_name THEN 'applied'
        WHEN name = failed_name THEN 'failed' ELSE 'not_attempted' END AS state
    FROM (SELECT p.db_id, p.name, g.checksum, v.statements, v.error,
        min(CASE WHEN v.error IS NOT NULL THEN p.name END) OVER (PARTITION BY p.db_id) AS failed_name
      FROM status p JOIN good g ON p.db_id = g.db_id AND p.name = g.name JOIN verdict v ON g.doc_id = v.id
      WHERE p.state = 'pending'
        AND p.db_id NOT IN (SELECT db_id FROM scan WHERE reason IS NOT NULL)
        AND p.db_id NOT IN (SELECT db_id FROM status WHERE state = 'mismatched')) r""",
        **_split_ctes("SELECT doc_id AS id, content AS text FROM good"),
        verdict=VERDICT,
    ),
)
def apply_plan(s):
    """The whole of a run: strict scan, gate, pending scripts, split, first failure."""
    return calls.up(s.scripts(), s.ledger(), NOW)["plan"].select(
        "db_id", "name", "checksum", "statements", "error", "failed_name", "state"
    )


# Whole calls ----------------------------------------------------------------------------

_LOST = "substr(name, 14, 1) IN ('3', '8') AND db_id IN ('src3', 'src14')"
#: The ledger with rows that lost their checksum in two databases.
HURT = f"SELECT db_id, name, CASE WHEN NOT ({_LOST}) THEN checksum END AS checksum, applied_at FROM ledger"
_BAD = """
  SELECT db_id, min(name) AS file, 'ledger row without checksum' AS reason FROM hurt WHERE checksum IS NULL GROUP BY db_id"""
_ILL = """
  SELECT db_id, min(name) AS file, arg_min(reason, name) AS reason FROM scan WHERE reason IS NOT NULL GROUP BY db_id"""
_WRONG = "SELECT * FROM ill UNION ALL SELECT * FROM bad WHERE db_id NOT IN (SELECT db_id FROM ill)"


def _hurt(tail: str, **more: str) -> str:
    return _files(tail, hurt=HURT, bad=_BAD, ill=_ILL, wrong=_WRONG, **more)


def _hurt_ledger(s):
    lost = F.substring("name", 14, 1).isin("3", "8") & F.col("db_id").isin("src3", "src14")
    return s.ledger().withColumn("checksum", F.when(~lost, F.col("checksum")))


@query(
    "status_call",
    _hurt("""
    SELECT 'state' AS part, db_id, name, state AS said FROM status WHERE db_id NOT IN (SELECT db_id FROM wrong)
    UNION ALL SELECT 'error', db_id, file, reason FROM wrong"""),
)
def status_call(s):
    got = calls.status(s.scripts(), _hurt_ledger(s), NOW)
    states = got["states"].select(F.lit("state").alias("part"), "db_id", "name", F.col("state").alias("said"))
    return states.unionByName(
        got["errors"].select(F.lit("error").alias("part"), "db_id", F.col("file").alias("name"), F.col("reason").alias("said"))
    )


@query(
    "up_blocked",
    _hurt(f"""
    SELECT 'blocked' AS part, db_id, min(name) AS name, arg_min(file_checksum, name) AS said FROM status
    WHERE state = 'mismatched' AND db_id NOT IN (SELECT db_id FROM wrong) GROUP BY db_id
    UNION ALL SELECT 'error', db_id, file, reason FROM wrong
    UNION ALL SELECT 'future', s.db_id, s.name, NULL FROM status s
    WHERE s.state = 'pending' AND {FUTURE} AND db_id NOT IN (SELECT db_id FROM wrong)
      AND db_id NOT IN (SELECT db_id FROM status WHERE state = 'mismatched')"""),
)
def up_blocked(s):
    got = calls.up(s.scripts(), _hurt_ledger(s), NOW)

    def part(label, rows, name, said):
        return rows.select(F.lit(label).alias("part"), "db_id", F.col(name).alias("name"), said.alias("said"))

    return (
        part("blocked", got["blocked"], "name", F.col("file_checksum"))
        .unionByName(part("error", got["errors"], "file", F.col("reason")))
        .unionByName(part("future", got["future_dated"], "name", F.lit(None).cast("string")))
    )


@query(
    "check_summary",
    _hurt(
        """
    SELECT db_id, reason, db_checked, invalid_names, pending, pending_bad, mismatched,
      reason IS NULL AND invalid_names = 0 AND pending_bad = 0 AND mismatched = 0 AS ok
    FROM (
      SELECT d.db_id, h.reason, r.db_id IS NOT NULL AND h.reason IS NULL AS db_checked,
        (SELECT count(*) FROM scan x WHERE x.db_id = d.db_id AND x.reason IS NOT NULL) AS invalid_names,
        count(f.name) FILTER (r.db_id IS NULL OR h.reason IS NOT NULL OR f.applied IS NULL) AS pending,
        count(f.name) FILTER (f.error IS NOT NULL AND (r.db_id IS NULL OR h.reason IS NOT NULL OR f.applied IS NULL)) AS pending_bad,
        count(f.name) FILTER (r.db_id IS NOT NULL AND h.reason IS NULL AND f.applied <> f.checksum) AS mismatched
      FROM databases d LEFT JOIN readable r ON d.db_id = r.db_id
      LEFT JOIN (SELECT * FROM bad WHERE db_id IN (SELECT db_id FROM readable)) h ON d.db_id = h.db_id
      LEFT JOIN (SELECT g.db_id, g.name, g.checksum, v.error, l.checksum AS applied FROM good g JOIN verdict v ON g.doc_id = v.id
        LEFT JOIN ledger l ON l.db_id = g.db_id AND l.name = g.name) f ON f.db_id = d.db_id
      GROUP BY d.db_id, h.reason, r.db_id) c""",
        databases=duck("databases"),
        readable=duck("readable"),
        **_split_ctes("SELECT doc_id AS id, content AS text FROM good"),
        verdict=VERDICT,
    ),
)
def check_summary(s):
    got = calls.check(s.scripts(), _hurt_ledger(s), s.databases(), s.readable(), NOW)["summary"]
    return got.select("db_id", "reason", "db_checked", "invalid_names", "pending", "pending_bad", "mismatched", "ok")


@query(
    "baseline_call",
    _hurt("""
    SELECT 'insert' AS part, db_id, name, file_checksum AS said FROM status
    WHERE state = 'pending' AND db_id NOT IN (SELECT db_id FROM wrong)
      AND db_id NOT IN (SELECT db_id FROM status WHERE state = 'mismatched')
    UNION ALL SELECT 'error', db_id, file, reason FROM wrong"""),
)
def baseline_call(s):
    got = calls.baseline(s.scripts(), _hurt_ledger(s), NOW)
    rows = got["inserts"].select(F.lit("insert").alias("part"), "db_id", "name", F.col("checksum").alias("said"))
    return rows.unionByName(
        got["errors"].select(F.lit("error").alias("part"), "db_id", F.col("file").alias("name"), F.col("reason").alias("said"))
    )


@query(
    "baseline_failures",
    _files("""
    SELECT db_id, count(*) AS n_rows, CASE WHEN down THEN 'unavailable'
        ELSE coalesce(arg_min(finding, name) FILTER (finding IS NOT NULL), 'skipped') END AS outcome,
      CASE WHEN NOT down THEN min(name) FILTER (finding IS NOT NULL) END AS first_name
    FROM (SELECT g.*, right(g.db_id, 1) = '5' AS down,
        CASE WHEN l.name IS NULL THEN 'failed' WHEN l.checksum <> g.checksum THEN 'mismatch' END AS finding
      FROM good g LEFT JOIN ledger l ON g.db_id = l.db_id AND g.name = l.name) j GROUP BY db_id, down"""),
)
def baseline_failures(s):
    """The databases whose number ends in 5 could not be reached."""
    kind = F.when(F.right("db_id", F.lit(1)) == "5", "unavailable").otherwise("worker")
    return st.baseline_outcome(_good(s), s.ledger(), s.databases().withColumn("kind", kind))


# Attempts -------------------------------------------------------------------------------

_SUFFIX = """CASE WHEN inner_code IS NULL THEN '' WHEN coalesce(driver, 'postgres') = 'postgres'
  THEN ' (SQLSTATE ' || inner_code || ')' ELSE ' (' || driver || ' error code ' || inner_code || ')' END"""
_ERRORS = f"""
  SELECT *, CASE WHEN NOT worker THEN 'unavailable' ELSE 'worker' END AS error_kind,
    CASE WHEN NOT worker THEN NULL WHEN structured THEN body_code ELSE code END AS error_code,
    CASE WHEN kind = 'timeout' THEN 'invocation timed out' WHEN kind = 'not_connected' THEN 'engine not connected'
      WHEN kind <> 'remote' THEN message
      WHEN code = 'function_not_found' THEN 'database worker function not registered (' || message || '); is the database worker running?'
      WHEN structured THEN body_message || {_SUFFIX} ELSE message END AS error_message
  FROM (SELECT *, kind = 'remote' AND code <> 'function_not_found' AS worker, coalesce(body_code IS NOT NULL, false) AS structured
    FROM (SELECT *, json_extract_string(body, '$.code') AS body_code, json_extract_string(body, '$.message') AS body_message,
        json_extract_string(body, '$.inner_code') AS inner_code, json_extract_string(body, '$.driver') AS driver,
        CAST(json_extract(body, '$.failed_index') AS BIGINT) AS failed_index
      FROM (SELECT *, CASE WHEN instr(message, '{{') > 0 THEN substr(message, instr(message, '{{')) END AS body
        FROM attempts WHERE NOT ok) a) b) c"""


def _tries(tail: str, **more: str) -> str:
    return with_(tail, attempts=duck("attempts"), errors=_ERRORS, **more)


def _failures(s):
    return er.normalise(s.attempts().where(~F.col("ok")))


def _attempts(s):
    """Attempts with the kind of failure their error text stands for."""
    return er.normalise(s.attempts()).withColumn("kind", F.col("error_kind"))


@query(
    "error_normalise",
    _tries("""
    SELECT event_id, error_kind, error_code, error_message,
      CASE WHEN worker AND structured THEN inner_code END AS inner_code,
      CASE WHEN worker AND structured THEN driver END AS driver,
      CASE WHEN worker AND structured THEN failed_index END AS failed_index,
      CASE WHEN worker AND error_code IN ('UNKNOWN_DB', 'CONFIG_ERROR') THEN 'CONFIG_ERROR' ELSE 'DATABASE_WORKER_UNAVAILABLE' END AS caller_code,
      CASE WHEN NOT worker THEN error_message
        WHEN error_code IN ('UNKNOWN_DB', 'CONFIG_ERROR') THEN 'database worker rejected the call: ' || error_message
        ELSE 'database call failed: ' || error_message END AS caller_message
    FROM errors"""),
)
def error_normalise(s):
    return er.for_callers(_failures(s)).select(
        "event_id", "error_kind", "error_code", "error_message", "inner_code", "driver",
        "failed_index", "caller_code", "caller_message",
    )


_RESPONSES = """
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"committed":true}'
    WHEN 1 THEN '{"committed":false,"failed_index":' || k || '}'
    WHEN 2 THEN '{"committed":false,"error":{"code":"DRIVER_ERROR","inner_code":"787","driver":"sqlite"},"failed_index":' || k || '}'
    ELSE '{"committed":false,"error":{"code":"DRIVER_ERROR","message":"refused","failed_index":' || k || '}}' END AS response
  FROM attempts"""


@query(
    "transaction_outcome",
    _tries(
        f"""
    SELECT event_id, committed, CASE WHEN NOT committed THEN error_code END AS error_code,
      CASE WHEN NOT committed THEN coalesce(body_message, 'transaction rolled back') || {_SUFFIX} END AS error_message,
      CASE WHEN NOT committed THEN failed_index END AS failed_index
    FROM (SELECT event_id, CAST(json_extract(response, '$.committed') AS BOOLEAN) AS committed,
        json_extract_string(response, '$.error.code') AS error_code,
        json_extract_string(response, '$.error.message') AS body_message,
        json_extract_string(response, '$.error.inner_code') AS inner_code,
        json_extract_string(response, '$.error.driver') AS driver,
        CAST(coalesce(json_extract(response, '$.error.failed_index'), json_extract(response, '$.failed_index')) AS BIGINT) AS failed_index
      FROM responses) r""",
        responses=_RESPONSES,
    ),
)
def transaction_outcome(s):
    tries = attempts_sql(s.dialect)
    responses = s.spark.sql(_RESPONSES.replace("FROM attempts", f"FROM ({tries}) a"))
    return er.rollbacks(responses).select(
        "event_id",
        F.col("error_kind").isNull().alias("committed"),
        "error_code",
        "error_message",
        "failed_index",
    )


@query(
    "hidden_scripts",
    ip.duck(f"""
    WITH files AS (
      SELECT source AS db_id, CASE doc_id % 5 WHEN 0 THEN '_draft' || CAST(doc_id AS VARCHAR) || '.sql' WHEN 1 THEN '.swap' || CAST(doc_id AS VARCHAR) || '.sql'
          ELSE CAST(20240101000000 + doc_id % 60 AS VARCHAR) || '_n' || CAST(doc_id AS VARCHAR) || '.sql' END AS name, text
      FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL)
    SELECT 'wrong' AS part, db_id, name, 'hidden' AS said FROM files WHERE name[1] IN ('_', '.')
    UNION ALL SELECT 'good', db_id, name, sha256(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) FROM files WHERE name[1] NOT IN ('_', '.')"""),
)
def hidden_scripts(s):
    """Documents written as files, some under names Spark's listing hides, and scanned again."""
    n = F.col("doc_id").cast("string")
    name = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("_draft"), n))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit(".swap"), n))
        .otherwise(F.concat((F.lit(20240101000000) + F.col("doc_id") % 60).cast("string"), F.lit("_n"), n))
    )
    docs = s.table("documents").where("doc_id IS NOT NULL AND source IS NOT NULL")
    files = docs.select(
        F.col("source").alias("db_id"),
        F.concat(name, F.lit(".sql")).alias("name"),
        F.coalesce("text", F.lit("")).cast("binary").alias("content"),
    )
    root = fresh_dir(s.spark, "scripts")
    fl.write_files(files, root)
    scanned = sc.scan(sc.read_scripts(s.spark, root))
    wrong = sc.invalid(scanned).select(F.lit("wrong").alias("part"), "db_id", F.col("file").alias("name"), F.lit("hidden").alias("said"))
    return wrong.unionByName(sc.valid(scanned).select(F.lit("good").alias("part"), "db_id", "name", F.col("checksum").alias("said")))


@query(
    "failed_statement",
    _tries("""
    SELECT event_id, failed_index,
      CASE WHEN failed_index >= event_id % 2 AND failed_index + 1 < 60 + event_id % 2 THEN failed_index - event_id % 2 END AS statement_index
    FROM (SELECT event_id, CASE WHEN worker AND structured THEN failed_index END AS failed_index FROM errors) e"""),
)
def failed_statement(s):
    """Scripts of 59 statements; the even half runs on SQLite, without a preamble."""
    offset = F.col("event_id") % 2
    index = F.col("failed_index")
    return _failures(s).select(
        "event_id",
        index,
        er.statement_index(index, offset, offset + 60).alias("statement_index"),
    )


_OUTCOMES = """
  SELECT a.*, f.first_ok_at, f.first_checksum,
    CASE WHEN a.ok THEN 'applied' WHEN e.error_kind = 'unavailable' THEN 'unavailable'
      WHEN f.first_ok_at <= a.ended_at AND f.first_checksum = a.checksum THEN 'skipped'
      WHEN f.first_ok_at <= a.ended_at THEN 'mismatch' ELSE 'failed' END AS outcome
  FROM attempts a LEFT JOIN errors e ON a.event_id = e.event_id
  LEFT JOIN (SELECT db_id, name, min(ended_at) AS first_ok_at, arg_min(checksum, (ended_at, checksum)) AS first_checksum
    FROM attempts WHERE ok GROUP BY db_id, name) f ON a.db_id = f.db_id AND a.name = f.name"""


@query(
    "attempt_outcome",
    _tries("SELECT event_id, db_id, name, replica, outcome FROM outcomes", outcomes=_OUTCOMES),
)
def attempt_outcome(s):
    return runs.attempt_outcome(_attempts(s)).select("event_id", "db_id", "name", "replica", "outcome")


@query(
    "run_summary",
    _tries(
        """
    SELECT r.db_id, r.replica, r.applied, coalesce(l.tracked, 0) + r.joined AS skipped, r.duration_ms
    FROM (SELECT db_id, replica, count(*) FILTER (outcome = 'applied') AS applied,
        count(*) FILTER (outcome = 'skipped') AS joined,
        (epoch_us(max(ended_at)) - epoch_us(min(attempted_at))) // 1000 AS duration_ms
      FROM outcomes GROUP BY db_id, replica) r
    LEFT JOIN (SELECT db_id, count(*) AS tracked FROM ledger GROUP BY db_id) l ON r.db_id = l.db_id""",
        outcomes=_OUTCOMES,
        ledger=duck("ledger"),
    ),
)
def run_summary(s):
    return runs.run_summary(runs.attempt_outcome(_attempts(s)), s.ledger())


@query(
    "double_applied",
    _tries("""
    SELECT db_id, name, count(*) FILTER (ok) AS times_applied FROM attempts
    GROUP BY db_id, name HAVING count(*) FILTER (ok) > 1"""),
)
def double_applied(s):
    return runs.double_applied(s.attempts())
