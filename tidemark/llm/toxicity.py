"""Toxicity by cumulative-link ordinal regression.

A text's features are its distinct words and their leading parts. One weight vector is shared
by all ordered thresholds: P(grade > k) = sigmoid(w x - t_k). The expected severity is the
sum of these over k, from 0 to the number of grades less one.

The model is fitted on a bounded sample of labelled rows (``FitLimits.rows``, by hash of the
id); everything else covers all rows. Labels say toxic or not; a toxic row's grade is 1, 2 or
3 by how many distinct toxic-associated words it has (``GRADES``).

Features are chosen and counted on the executors; the driver gets at most ``features`` of
them and the sample's rows in terms of them. Each text is scored in its own row.

* Null or empty text: no features, the severity of the bias alone, never toxic.
* Labels that are null, other than 0 and 1, or without a document are left out; with no usable
  labels of both kinds nothing is toxic and every severity is 0.
* Repeated rows are scored one by one; repeated labels and texts count once in the sample.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM_TABLE, named, raw, texts

#: Least numbers of distinct toxic-associated words for grades 1, 2 and 3.
GRADES = (0, 2, 4)
PARTS = (4, 5, 6)


@dataclass(frozen=True)
class FitLimits:
    rows: int = 20_000
    features: int = 4_096
    support: int = 5
    steps: int = 400
    decay: float = 3e-4
    held_out: int = 5
    least_cut: float = 0.5


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    thresholds: tuple[float, ...]
    cut: float

    def severity(self, total: float) -> float:
        return float(sum(1 / (1 + np.exp(t - total)) for t in self.thresholds))


def features(word: bytes) -> list[bytes]:
    return [word + b"$"] + [word[:k] for k in PARTS if len(word) >= k]


class Known(dict):
    """The chosen features of a word, remembered up to a bound."""

    LIMIT = 300_000

    def __init__(self, chosen):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: bytes) -> list[bytes]:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = [f for f in features(word) if f in self.chosen]
        return value


def _sample(docs: DataFrame, labels: DataFrame, limits: FitLimits) -> DataFrame:
    """text, toxic of a bounded number of labelled documents, each text once."""
    usable = labels.select(named("doc_id").alias("doc_id"), named("toxic").cast("int").alias("toxic"))
    usable = usable.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits.rows)
    labelled = texts(docs).join(F.broadcast(picked), "doc_id")
    return labelled.groupBy(F.xxhash64("text").alias("part")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic")
    )


def _counts(sample: DataFrame) -> DataFrame:
    """feature, n, n_toxic: numbers of texts."""

    def run(batches):
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for body, is_toxic in zip(raw(batch.column(0)), batch.column(1).to_pylist()):
                own = {f for w in set(body.translate(ALNUM_TABLE).split()) for f in features(w)}
                seen.update(own)
                if is_toxic:
                    toxic.update(own)
            if len(seen) > 1_000_000:
                yield flushed(seen, toxic)
                seen, toxic = Counter(), Counter()
        yield flushed(seen, toxic)

    def flushed(seen, toxic):
        names = list(seen)
        arrays = [pa.array(names, pa.binary()), pa.array([seen[f] for f in names], pa.int64()), pa.array([toxic[f] for f in names], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["feature", "n", "n_toxic"])

    made = sample.select("text", "toxic").mapInArrow(run, "feature binary, n bigint, n_toxic bigint")
    return made.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def _rows(sample: DataFrame, chosen: set[bytes], telling: set[bytes]) -> list:
    """Of each sampled text: its chosen features, its telling words, toxic, a split number."""

    def run(batches):
        known = Known(chosen)
        for batch in batches:
            found, words = [], []
            for body in raw(batch.column(1)):
                own = set(body.translate(ALNUM_TABLE).split())
                found.append(sorted({f for w in own for f in known[w]}))
                words.append(sum(any(f in telling for f in known[w]) for w in own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.binary())), pa.array(words, pa.int64()), batch.column(2)],
                ["part", "found", "words", "toxic"],
            )

    schema = "part bigint, found array<binary>, words bigint, toxic int"
    return sorted(sample.select("part", "text", "toxic").mapInArrow(run, schema).collect())


def cumulative_link(
    indexes: list[np.ndarray], grades: np.ndarray, size: int, levels: int, steps: int, decay: float
) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and rising thresholds by Adam on the ordinal log-likelihood."""
    flat = np.concatenate([*indexes, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(indexes)), [len(i) for i in indexes])
    above = (grades[:, None] > np.arange(levels)).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    # Thresholds are the first one plus positive steps, so they stay in order.
    params = np.r_[np.zeros(size), start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, steps_up = params[:size], np.exp(params[size + 1 :])
        thresholds = params[size] + np.r_[0, np.cumsum(steps_up)]
        total = np.bincount(row, w[flat], len(indexes))
        p = 1 / (1 + np.exp(np.clip(thresholds - total[:, None], -30, 30)))
        # P(grade = k) = p[k-1] - p[k]; its log's gradient by the two cumulative parts.
        edge = np.c_[np.ones(len(grades)), p, np.zeros(len(grades))]
        slope = edge * (1 - edge)
        at = np.arange(len(grades))
        chance = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-9)
        lower, upper = slope[at, grades] / chance, slope[at, grades + 1] / chance
        by_total = -(lower - upper) / len(grades)
        by_threshold = np.zeros(levels + 2)
        np.add.at(by_threshold, grades, lower / len(grades))
        np.add.at(by_threshold, grades + 1, -upper / len(grades))
        t = by_threshold[1:-1]
        gradient = np.r_[np.bincount(flat, by_total[row], size) + decay * w, t.sum(), np.cumsum(t[::-1])[::-1][1:] * steps_up]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:size], params[size] + np.r_[0, np.cumsum(np.exp(params[size + 1 :]))]


def fit(docs: DataFrame, labels: DataFrame, limits: FitLimits = FitLimits()) -> Model:
    sample = _sample(docs, labels, limits)
    whole = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, n_toxic = sum(whole.values()), whole.get(1, 0)
    if not n_toxic or n == n_toxic:
        return Model({}, (), 1.0)
    share = n_toxic / n
    counts = _counts(sample).where(F.col("n") >= limits.support)
    z = (F.col("n_toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counts.withColumn("z", z).orderBy(F.abs("z").desc(), "feature").limit(limits.features).collect()
    chosen = {bytes(r["feature"]) for r in best}
    telling = {bytes(r["feature"]) for r in best if r["z"] > 0 and r["n_toxic"] >= 0.8 * r["n"]}
    rows = _rows(sample, chosen, telling)
    order = sorted(chosen)
    place = {f: i for i, f in enumerate(order)}
    indexes = [np.array([place[bytes(f)] for f in r["found"]], np.int64) for r in rows]
    toxic = np.array([r["toxic"] for r in rows])
    grades = np.where(toxic == 0, 0, np.searchsorted(GRADES, [r["words"] for r in rows], "right").clip(1))
    levels = int(grades.max())
    held = np.array([r["part"] % limits.held_out == 0 for r in rows])
    if held.all() or not toxic[~held].any() or toxic[~held].all():
        held[:] = False
    train = np.flatnonzero(~held)
    grades = np.minimum(grades, grades[train].max())
    levels = int(grades.max())
    w, thresholds = cumulative_link([indexes[i] for i in train], grades[train], len(order), levels, limits.steps, limits.decay)
    model = Model({f: float(x) for f, x in zip(order, w) if abs(x) > 1e-6}, tuple(map(float, thresholds)), 0.5)
    judged = np.flatnonzero(held) if toxic[held].any() else np.arange(len(rows))
    severity = np.array([model.severity(float(w[indexes[i]].sum())) for i in judged])
    return Model(model.weights, model.thresholds, max(limits.least_cut, best_cut(severity, toxic[judged])))


def best_cut(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap in severity that gives the highest F1 for ``toxic``."""
    order = np.argsort(-severity, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    ends = np.r_[severity[order][1:] != severity[order][:-1], True]
    at = int(np.argmax(np.where(ends, f1, -1)))
    below = severity[order][at + 1] if at + 1 < len(order) else 0.0
    return float((severity[order][at] + below) / 2)


def _scored(docs: DataFrame, model: Model, at: int, schema: str, emit) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        known = Known(model.weights)
        for batch in batches:
            severity = []
            for body in raw(batch.column(at)):
                own = {f for w in set(body.translate(ALNUM_TABLE).split()) for f in known[w]}
                severity.append(model.severity(sum(sorted(model.weights[f] for f in own))))
            toxic = [bool(own) and s >= model.cut for s, own in zip(severity, raw(batch.column(at)))]
            yield emit(batch, severity, toxic)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected severity, the most likely reading of it as a grade, toxic."""

    def emit(batch, severity, toxic):
        arrays = [batch.column(0), pa.array(severity, pa.float64()), pa.array([round(s) for s in severity], pa.int32()), pa.array(toxic, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "severity", "grade", "toxic"])

    narrow = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return _scored(narrow, model, 1, "doc_id bigint, severity double, grade int, toxic boolean", emit)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, whose ``text`` is not toxic."""

    def emit(batch, _, toxic):
        return batch.filter(pa.array([not x for x in toxic], pa.bool_()))

    return _scored(docs, model, docs.columns.index("text"), docs.schema, emit)
