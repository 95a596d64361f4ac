"""Secret scans: three fixed patterns, and sliding-window entropy of candidate strings.

Candidate strings are maximal runs of one character class. A window slides along each; the
counts of its characters change by two per step and so does the sum of c * log2(c), which
gives the window's Shannon entropy in constant time. Windows at or above the class's
threshold are joined to spans; candidates that an allow-list knows are left out, and the
letters and digits around a word like "example", up to the next other character.

Every text is scanned in its own row, so nothing is shuffled. Time is linear in the text.

* Null or empty text: no spans. Repeated rows are scanned one by one.
* Positions are code points, end exclusive; spans of one kind never overlap.
* Columns besides the two named ones are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import named, texts

#: Kinds in their order within one start.
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars``; windows of ``window`` characters need ``bits`` and ``mix``. ``bare``: no letter or digit stands beside the run."""

    chars: str
    window: int
    bits: float
    mix: tuple[str, ...]
    bare: bool = False


CLASSES = (
    CharClass("0-9A-Fa-f", 20, 3.0, ("0-9", "A-Fa-f")),
    CharClass("A-Za-z0-9+/_-", 20, 3.6, ("0-9", "A-Z", "a-z")),
    CharClass("0-9a-z", 24, 3.8, ("0-9", "a-z"), True),
    CharClass("0-9A-Z", 24, 3.8, ("0-9", "A-Z"), True),
)
#: Candidates that are known not to be secrets.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"(?:[A-Za-z]+[/_-])+[A-Za-z]*\d{0,4}",  # paths and joined words
    r"\d{4}-\d\d-\d\dT?[\d_-]*",  # dates
    r"[0-9+/_-]+",
)
#: What makes the part of a candidate that it stands in, between "+", "/", "_" and "-", no secret.
ALLOWED_PARTS = re.compile(r"(?i:example|placeholder|sample|(?<![a-z0-9])x{4,})")
JOINS = re.compile(r"[+/_-]")


def high_entropy(run: str, size: int, bits: float, mix: tuple[frozenset, ...]) -> list[tuple[int, int]]:
    """Spans of ``run`` covered by windows of at least ``bits`` that hold every set of ``mix``."""
    if len(run) < size:
        return []
    log = [0.0, 0.0] + [c * math.log2(c) for c in range(2, size + 1)]
    counts: dict[str, int] = {}
    held = [0] * len(mix)
    total, limit = 0.0, (math.log2(size) - bits) * size + 1e-9
    spans: list[tuple[int, int]] = []
    for i, char in enumerate(run):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += log[c + 1] - log[c]
        for k, chars in enumerate(mix):
            held[k] += char in chars
        if i >= size:
            old = run[i - size]
            c = counts[old]
            counts[old] = c - 1
            total += log[c - 1] - log[c]
            for k, chars in enumerate(mix):
                held[k] -= old in chars
        if i >= size - 1 and total <= limit and all(held):
            start = i - size + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _expanded(chars: str) -> frozenset:
    return frozenset(re.findall(f"[{chars}]", "".join(map(chr, range(128)))))


class Scanner:
    """The scan of one text; compiled once per task."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.classes = [
            (
                re.compile(f"(?<![0-9A-Za-z])[{c.chars}]{{{c.window},}}(?![0-9A-Za-z])" if c.bare else f"[{c.chars}]{{{c.window},}}"), c.window, c.bits,
                tuple(_expanded(m) for m in c.mix),
            )
            for c in classes
        ]
        self.allowed = re.compile("|".join(f"(?:{a})" for a in allowed))

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found = []
        if ":" in text or "=" in text:
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
        if "AKIA" in text:
            found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        return found

    def entropy(self, text: str) -> list[tuple[str, int, int]]:
        spans: list[tuple[int, int]] = []
        for pattern, window, bits, mix in self.classes:
            for m in pattern.finditer(text):
                for start, run in self.unknown(m[0], m.start()):
                    spans += [(start + a, start + b) for a, b in high_entropy(run, window, bits, mix)]
        out: list[tuple[int, int]] = []
        for start, end in sorted(spans):
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
        return [("entropy", *s) for s in out]

    def unknown(self, run: str, at: int) -> list[tuple[int, str]]:
        """What no allow-list knows of a run that starts at ``at``."""
        if self.allowed.fullmatch(run):
            return []
        known = []
        for m in ALLOWED_PARTS.finditer(run):
            done = known[-1][1] if known else 0
            if m.end() > done:
                start = max(done, *(run.rfind(c, done, m.start()) + 1 for c in "+/_-"))
                end = JOINS.search(run, m.end())
                known.append((start, end.start() if end else len(run)))
        found, start = [], 0
        for a, b in [*known, (len(run), len(run))]:
            rest = run[start:a]
            if rest and (rest == run or not self.allowed.fullmatch(rest.strip("+/_-"))):
                found.append((at + start, rest))
            start = b
        return found

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        found = self.base(text) + self.entropy(text)
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(
    docs: DataFrame,
    classes: tuple[CharClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id and its ``spans``, by start, then kind as listed."""

    def run(batches):
        scanner = Scanner(classes, allowed)
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end"), s)) for s in scanner.scan(t or "")]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"])

    schema = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"
    narrow = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return narrow.mapInArrow(run, schema)


def redacted(docs: DataFrame, mask: str = "[secret]", text: str = "text") -> DataFrame:
    """``docs`` with every span found in ``text`` replaced by ``mask``; a null text stays null."""
    at = docs.columns.index(text)

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            clean = []
            for body in batch.column(at).to_pylist():
                parts, done = [], 0
                for _, start, end in scanner.scan(body or ""):
                    if start >= done:
                        parts += [body[done:start], mask]
                    done = max(done, end)
                clean.append("".join([*parts, body[done:]]) if parts else body)
            arrays = list(batch.columns)
            arrays[at] = pa.array(clean, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the fixed patterns' spans, and all spans as text."""

    def joined(spans: Column) -> Column:
        shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, shown), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
