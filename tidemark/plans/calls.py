"""The user-level calls, each over a whole fleet of databases at once.

``files`` has db_id, name, content (``sources.scripts.read_scripts``); ``ledger`` has
db_id, name, checksum, applied_at.  Each result holds named parts.  Building it runs jobs
where parts share facts, which are then pinned: narrow facts of scripts and the pending
ones in ``up`` and ``check``, sorted requests in ``create``, judged targets in ``baseline``,
and names and refusals in ``adopt``.  Use ``session.pins`` to have them deleted afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import checksum, raw_checksum
from tidemark.functions.names import Moment
from tidemark.operators import catalog, contracts, history, keyed, runs, status as st
from tidemark.session import pin
from tidemark.sources import journal, ledger as ledgers, scripts as sc

LEDGER_TABLE = "schema_ledger"


def _first_errors(*errors: DataFrame) -> DataFrame:
    """One row per database: db_id, file, reason of the first list that has it."""
    ranked = [e.select("db_id", F.lit(k).alias("_k"), "file", "reason") for k, e in enumerate(errors)]
    both = ranked[0]
    for more in ranked[1:]:
        both = both.unionByName(more)
    first = F.min(F.struct("_k", "file", "reason")).alias("_e")
    return both.groupBy("db_id").agg(first).select("db_id", "_e.file", "_e.reason")


def _strict(facts: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scripts, ledger rows, errors): a database with an ill-named script or a broken ledger
    row is in ``errors`` only."""
    errors = _first_errors(sc.first_invalid(facts), ledgers.first_broken(ledger))
    found = keyed.attach(sc.valid(facts), errors, ["db_id"], how="left_anti")
    return found, keyed.attach(ledgers.sound(ledger), errors, ["db_id"], how="left_anti"), errors


def status(files: DataFrame, ledger: DataFrame, now: Moment) -> dict[str, DataFrame]:
    """State of every script and ledger row.  Databases with an ill-named script or a ledger
    row without name or checksum are in ``errors`` only."""
    found, rows, errors = _strict(sc.scan(files), ledger)
    return {
        "states": st.ledger_status(found, rows),
        "future_dated": st.future_dated(found, rows, now),
        "errors": errors,
    }


def up(files: DataFrame, ledger: DataFrame, now: Moment) -> dict[str, DataFrame]:
    """What a run would do: ``plan`` has every pending script of the unblocked databases
    with its state after the run; ``blocked`` names the drift that stops a database;
    ``future_dated`` warns.  Contents are read once, and recorded scripts are not split
    (see ``scan``)."""
    facts = pin(sc.scan(files, verdicts=True, recorded=ledgers.sound(ledger)))
    found, rows, errors = _strict(facts, ledger)
    blocked = st.blocked(st.checksum_gate(found, rows))
    free = keyed.attach(found, blocked, ["db_id"], how="left_anti")
    columns = ["db_id", "name", "checksum", "ok", "statements", "error"]
    waiting = pin(st.pending(free, rows).select(*columns))
    return {
        "plan": runs.run_replay(waiting),
        "blocked": blocked,
        "future_dated": st.future_dated(waiting, rows, now),
        "errors": errors,
    }


def check(
    files: DataFrame, ledger: DataFrame, databases: DataFrame, readable: DataFrame, now: Moment
) -> dict[str, DataFrame]:
    """Would a run succeed, and what speaks against it.

    ``readable`` lists the databases whose ledger could be read; the others get the
    static checks only, as does one with a broken ledger row, which fails with that
    ``reason``.  ``summary`` has one row per database, the other parts name the scripts:
    ``pending`` with their split, ``invalid``, ``future_dated`` and ``drift`` (mismatched
    and missing).  Contents are read once, and recorded scripts are not split.
    """
    reading = readable.select("db_id").distinct()
    errors = ledgers.first_broken(ledger).join(reading, "db_id", "left_semi")
    sound = reading.join(errors, "db_id", "left_anti")
    known = keyed.attach(ledgers.sound(ledger), sound, ["db_id"], how="left_semi")
    judged_all = pin(sc.scan(files, verdicts=True, recorded=known))
    facts = judged_all.drop("ok", "statements", "error")
    scripts = sc.valid(judged_all)
    judged = pin(st.pending(scripts, known).select("db_id", "name", "ok", "statements", "error"))
    summary = st.check_rollup(
        databases, facts.join(judged, ["db_id", "name"], "left"), known, sound, now
    )
    reasons = summary.join(errors.select("db_id", "reason"), "db_id", "left")
    return {
        "summary": reasons.withColumn("ok", F.col("ok") & F.col("reason").isNull()),
        "pending": judged,
        "invalid": sc.invalid(facts),
        "future_dated": st.future_dated(sc.valid(facts), known, now),
        "drift": st.ledger_check(sc.valid(facts), known),
        "errors": errors,
    }


def create(requests: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Names for requested scripts, after everything that is there."""
    given, refused = history.allocate_names(requests, sc.valid(sc.scan(files)))
    return {"names": given, "refused": refused}


def codegen(
    columns: DataFrame, enum_labels: DataFrame | None, ledger_table: str = LEDGER_TABLE
) -> dict[str, DataFrame]:
    """Type declarations as rows, and how many tables and enums each database has."""
    typed = (
        contracts.pg_contract_columns(columns, enum_labels)
        if enum_labels is not None
        else contracts.sqlite_contract_columns(columns)
    )
    return {
        "rows": contracts.contract_rows(typed, enum_labels, ledger_table),
        "counts": contracts.contract_counts(columns, enum_labels, ledger_table),
    }


def schema(
    columns: DataFrame,
    keys: DataFrame,
    foreign: DataFrame,
    indexes: DataFrame,
    triggers: DataFrame,
    enum_labels: DataFrame | None = None,
    table: str | None = None,
    ledger_table: str = LEDGER_TABLE,
) -> dict[str, DataFrame]:
    """Tables with all their parts, and the enums of each database."""
    report = catalog.schema_report(columns, keys, foreign, indexes, triggers, ledger_table, table)
    out = {"tables": report}
    if enum_labels is not None:
        out["enums"] = catalog.fold_enums(enum_labels)
    return out


def baseline(
    files: DataFrame, ledger: DataFrame, now: Moment, names: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Record scripts as applied without running them: all, or the requested ones.

    ``inserts`` are the rows to append; a database with a mismatch, an unknown name, an
    ill-named script or a broken ledger row gets none.
    """
    found, rows, errors = _strict(sc.scan(files), ledger)
    out = {"errors": errors}
    if names is not None:
        found, unknown = st.baseline_targets(found, names)
        out["unknown"] = unknown
        found = keyed.attach(
            found, unknown.select("db_id").dropDuplicates(), ["db_id"], how="left_anti"
        )
    plan = st.baseline_plan(found, rows)
    out["plan"] = plan
    out["inserts"] = plan.where(F.col("action") == "insert").select(
        "db_id", "name", "checksum", F.lit(now).cast("timestamp_ntz").alias("applied_at")
    )
    return out


def adopt(
    journals: DataFrame,
    source_files: DataFrame,
    foreign: DataFrame,
    files: DataFrame,
    ledger: DataFrame,
    dialects: DataFrame,
    now: Moment,
    mode: str = "auto",
) -> Mapping[str, DataFrame]:
    """Take over another tool's history.

    ``source_files`` has db_id, tag, content.  ``refused`` says which databases are not
    taken over: an unfit journal, an entry that gets no name, other content under an
    entry's name, or a broken ledger row; they have no states and no inserts.  ``imports``
    says per entry which file to write; ``states`` what counts as applied and where
    content drifted; ``inserts`` are the ledger rows of the applied ones.
    """
    entries = journal.entries(journals)
    unfit = history.adopt_source_check(journals, entries, dialects, source_files).where(
        F.col("reason").isNotNull()
    )
    hashed = source_files.select(
        "db_id",
        "tag",
        raw_checksum(F.col("content")).alias("raw_hash"),
        checksum(F.col("content")).alias("checksum"),
    )
    fit = keyed.attach(entries, unfit, ["db_id"], how="left_anti")
    items = pin(history.monotonic_names(fit).join(hashed, ["db_id", "tag"]))
    unnamed = items.where(F.col("reason").isNotNull())
    imports = history.import_decision(
        items.where(F.col("reason").isNull()), sc.valid(sc.scan(files))
    )
    refused = pin(_import_refusals(unfit, unnamed, imports, ledger))
    taken = keyed.attach(
        items.where(F.col("reason").isNull()), refused, ["db_id"], how="left_anti"
    )
    states = history.adopt_match(taken, journal.foreign_rows(foreign), mode)

    def plan() -> DataFrame:
        targets = states.where(F.col("state") == "applied").select(
            "db_id", F.col("target_name").alias("name"), "checksum"
        )
        return st.baseline_plan(targets, ledgers.sound(ledger))

    return Parts(
        refused=lambda: refused,
        unnamed=lambda: unnamed,
        imports=lambda: imports,
        states=lambda: states,
        plan=plan,
        inserts=lambda parts: parts["plan"]
        .where(F.col("action") == "insert")
        .select("db_id", "name", "checksum", F.lit(now).cast("timestamp_ntz").alias("applied_at")),
    )


def _import_refusals(
    unfit: DataFrame, unnamed: DataFrame, imports: DataFrame, ledger: DataFrame
) -> DataFrame:
    """db_id, reason: why a database's history is not taken over at all."""
    first_unnamed = unnamed.groupBy("db_id").agg(F.min(F.struct("idx", "pos", "tag", "reason")).alias("_u"))
    clash = imports.where(F.col("decision") == "conflict")
    first_clash = clash.groupBy("db_id").agg(F.min("target_name").alias("_c"))
    quoted = lambda what, name: F.concat(F.lit(what), F.lit(" `"), name, F.lit("`"))
    none = F.lit(None).cast("string").alias("file")
    return _first_errors(
        unfit.select("db_id", none, "reason"),
        first_unnamed.select(
            "db_id",
            none,
            F.concat(quoted("journal entry", F.col("_u.tag")), F.lit(" gets no name: "), F.col("_u.reason")).alias("reason"),
        ),
        first_clash.select(
            "db_id", none, F.concat(quoted("other content is there as", F.col("_c"))).alias("reason")
        ),
        ledgers.first_broken(ledger),
    ).select("db_id", "reason")


class Parts(Mapping):
    """Named parts, each made when it is first asked for."""

    def __init__(self, **makers: Callable[..., DataFrame]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            make = self._makers[name]
            self._made[name] = make(self) if make.__code__.co_argcount else make()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)
