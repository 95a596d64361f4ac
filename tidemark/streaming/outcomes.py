"""What each attempt means, as attempts arrive: keyed state with timers.

A failed attempt is read against the ledger as it stood when the attempt ended, so attempts
must be judged in the order in which they ended, not in which they arrive. A key's attempts
wait in its state until the watermark has passed them, then are judged in order: the first
success is the key's ledger row, whatever comes later is compared to it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEY = ["db_id", "name"]
OUTCOMES = (
    "db_id string, name string, event_id bigint, ended_at timestamp, checksum string, outcome string, "
    "conflict boolean, first_ok_at timestamp, first_checksum string"
)
# Up to _PACK attempts in one value, as the state costs by the value.
_WAITING = "attempts binary"
_PACK = 10_000
#: Setting that keyed state with timers needs, and its value.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def _outcome(ok: bool, kind: str | None, checksum: str | None, first: tuple | None) -> str:
    if ok:
        return "applied"
    if kind == "unavailable":
        return "unavailable"
    if first is None:
        return "failed"
    return "skipped" if first[1] == checksum else "mismatch"


def _millis(at: datetime) -> int:
    """The first millisecond that is not before ``at``."""
    whole = (at.replace(tzinfo=at.tzinfo or timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc))
    return -(-(whole.days * 86_400_000_000 + whole.seconds * 1_000_000 + whole.microseconds) // 1000)


def _packed(rows: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(rows[k : k + _PACK]),) for k in range(0, len(rows), _PACK)]


class Judge(StatefulProcessor):
    """State of a key: its first success, the attempts that wait, and its one timer.

    The timer stands at the least time at which an attempt falls due or the first success is
    forgotten, so a key is judged once per batch whatever the number of its attempts.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at timestamp, checksum string")
        self.waiting = handle.getListState("waiting", _WAITING)
        self.alarm = handle.getValueState("alarm", "at bigint")

    def _wake(self, at: int) -> None:
        """Lets the key's timer stand at ``at``, if it does not stand earlier."""
        stands = self.alarm.get()[0] if self.alarm.exists() else None
        if stands is not None and stands <= at:
            return
        if stands is not None:
            self.handle.deleteTimer(stands)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = []
        for batch in rows:
            for r in batch.itertuples(index=False):
                at = r.ended_at.to_pydatetime()
                kind, checksum = (None if pd.isna(x) else x for x in (r.kind, r.checksum))
                held.append((int(r.event_id), at, bool(r.ok), kind, checksum))
        if held:
            self.waiting.appendList(_packed(held))
            self._wake(_millis(min(r[1] for r in held)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.alarm.clear()  # a timer that has expired is gone
        rows = [r for (held,) in self.waiting.get() for r in pickle.loads(held)] if self.waiting.exists() else []
        ready = sorted((r for r in rows if _millis(r[1]) <= now), key=lambda r: (r[1], not r[2], r[4] or "", r[0]))
        first = tuple(self.first.get()) if self.first.exists() else None
        out = []
        for event_id, at, ok, kind, checksum in ready:
            if first and _millis(first[0]) + self.keep_ms < _millis(at):
                first = None  # forgotten
            if ok and first is None:
                first = (at, checksum)
            conflict = ok and first[1] != checksum
            out.append((*key, event_id, at, checksum, _outcome(ok, kind, checksum, first), conflict, *(first or (None, None))))
        left = [r for r in rows if _millis(r[1]) > now]
        if left:
            self.waiting.put(_packed(left))
        elif rows:
            self.waiting.clear()
        if first and _millis(first[0]) + self.keep_ms >= now:
            self.first.update(first)
            self._wake(_millis(first[0]) + self.keep_ms + 1)
        else:
            self.first.clear()
        if left:
            self._wake(min(_millis(r[1]) for r in left))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def outcomes(attempts: DataFrame, delay: str, keep: str = "3650 days") -> DataFrame:
    """Every attempt once, when the watermark has passed it: its outcome, whether it is a
    success with another checksum than the first (``conflict``), and the first success.

    ``delay`` is how late attempts may come; later ones are dropped. ``keep`` is how long a
    first success is remembered; after that the next one counts as the first. Ties: a success
    comes before a failure, and the lesser checksum first. A null key is a key like any.
    The session needs the setting ``STATE_STORE``.
    """
    at = F.col("ended_at").cast("timestamp")
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = attempts.select(*KEY, "event_id", at.alias("ended_at"), "ok", "kind", "checksum").withWatermark("ended_at", delay)
    return rows.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=Judge(keep_ms), outputStructType=OUTCOMES, outputMode="append", timeMode="EventTime"
    )


def conflicts(attempts: DataFrame, delay: str, keep: str = "3650 days") -> DataFrame:
    """Successes with another checksum than the key's first one."""
    return outcomes(attempts, delay, keep).where("conflict").drop("conflict", "outcome")
