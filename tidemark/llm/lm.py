"""Language-model scoring: causal self-attention in numpy over subword ids, and a word unigram.

Texts whose crc32(doc_id as text) mod 7 is not 2 are learned from; all are scored.

Words. Training words are counted (with one end per text) in a table of any size. The most
frequent ones, at most ``head``, go to every task; the other words of a text are joined with
the table by word. A word outside the head is by construction no hot key.

Model. Words are cut to ids of a public tokenizer, once, and the ids written to the shared folder
for training and scoring. Ids are put in classes of about equal
mass; P(id | before) = P(class | before) P(id | class), the second factor being counts, the
first one causal self-attention over the ids before. Every task trains a copy of the network
on windows of all its training texts, cut as for scoring: one in ``every`` per round, others
each round, so that ``every`` rounds read each once. Copies are averaged, in two steps, for
the next round. How often a window is read does not depend on how rows are dealt to tasks.
Windows overlap; each id and each end is scored, and is a target of training, in one window,
with at least ``overlap`` tokens before it unless the text begins there.

* Null or empty text: only the end is scored. A null doc_id counts as empty text.
* No training text at all: counts are zero and the network is the initial one.
* Rows with equal ids are scored one by one; other columns are ignored.
* Very long texts are scored window by window; memory follows the text's ids, not their square.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import raw, texts
from tidemark.session import pin

END_WORD = b""


@dataclass(frozen=True)
class Shape:
    units: int = 2048
    classes: int = 32
    width: int = 16
    window: int = 32
    overlap: int = 16
    rounds: int = 2
    every: int = 2
    chunk_words: int = 12  # not used since windows are cut by ids
    batch: int = 128
    least_steps: int = 120  # not used since a task repeats nothing by its size
    rate: float = 0.01
    head: int = 200_000

    def __post_init__(self):
        if self.rounds % self.every:
            raise ValueError("rounds must be a multiple of every, or some windows are read less often than others")


# --- the network ---------------------------------------------------------------------------


def initial(shape: Shape) -> dict[str, np.ndarray]:
    rng, d = np.random.default_rng(7), shape.width
    sizes = {"E": (shape.units + shape.classes + 1, d), "P": (shape.window, d), "Wq": (d, d), "Wk": (d, d),
             "Wv": (d, d), "Wo": (d, shape.classes), "b": (shape.classes,)}
    return {
        k: (np.zeros(s) if k == "b" else rng.normal(0, 0.3 if k in "EP" else d**-0.5, s)).astype(np.float32)
        for k, s in sizes.items()
    }


#: Up to this range of exponents one common shift serves all rows of a softmax.
RANGE = 60


def _exps(s: np.ndarray, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Shifted exponentials along the last axis, their sums and the shift; ``late`` has 0 for the last places that do not count."""
    top = s.max(initial=0)
    if top - s.min(initial=0) > RANGE:
        if late is not None:
            s[..., -late.shape[1] :] += np.where(late > 0, 0, -1e9).astype(s.dtype)
        top = s.max(axis=-1, keepdims=True)
    s -= top
    e = np.exp(s, out=s)
    if late is not None:
        e[..., -late.shape[1] :] *= late
    return e, (e.reshape(-1, e.shape[-1]) @ np.ones(e.shape[-1], e.dtype)).reshape(*e.shape[:-1], 1), top


def _attended(p: dict, x: np.ndarray, since: int) -> tuple:
    """What the classes after ``x`` (batch, window) from place ``since`` on are told by, and what led there.

    Keys are multiplied into queries, and values after the sum, so both cost what the late places do.
    """
    n, size = x.shape
    d = p["Wq"].shape[0]
    h = p["E"][x]
    h += p["P"][:size]
    late = np.ascontiguousarray(h[:, since:]).reshape(-1, d)
    t = (late @ ((p["Wq"] @ p["Wk"].T) * np.float32(d**-0.5))).reshape(n, size - since, d)
    e, total, _ = _exps(t @ h.transpose(0, 2, 1), np.tri(size - since, dtype=h.dtype))
    u = ((e @ h) / total).reshape(-1, d)
    return late + u @ p["Wv"], h, late, t, e, total, u


def forward(p: dict, x: np.ndarray, since: int = 0) -> tuple:
    """Log-probabilities (natural) of the next class after each of ``x`` (batch, window) from place ``since`` on."""
    n, size = x.shape
    z, *led = _attended(p, x, since)
    logits = (z @ p["Wo"] + p["b"]).reshape(n, size - since, -1)
    _, total, top = _exps(logits.copy())
    return logits - (np.log(total) + top), led


def of_classes(p: dict, x: np.ndarray, y: np.ndarray, since: int = 0) -> np.ndarray:
    """``forward``'s log-probabilities of the classes ``y``."""
    logits = _attended(p, x, since)[0] @ p["Wo"]
    logits += p["b"]
    picked = logits[np.arange(y.size), y.ravel()]
    _, total, top = _exps(logits)
    return (picked - (np.log(total) + top)[:, 0]).reshape(y.shape)


def gradients(p: dict, x: np.ndarray, y: np.ndarray, valid: np.ndarray, since: int = 0) -> tuple[float, dict]:
    """Mean loss over valid places, the first of which is ``since``, and its gradient."""
    z, h, late, t, e, total, u = _attended(p, x, since)
    many, size = x.shape
    d = p["Wq"].shape[0]
    at, n = np.arange(y.size), max(1, int(valid.sum()))
    share = (valid.ravel() / n).astype(h.dtype)
    dl = z @ p["Wo"]
    dl += p["b"]
    picked = dl[at, y.ravel()]
    dl, sums, top = _exps(dl)
    loss = float(((np.log(sums) + top)[:, 0] - picked) @ share)
    dl *= share[:, None] / sums
    dl[at, y.ravel()] -= share
    dz = dl @ p["Wo"].T
    dv = (dz @ p["Wv"].T) / total.reshape(-1, 1)
    own = dv.reshape(many, -1, d)
    ds = own @ h.transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", dv, u).reshape(many, -1, 1)
    ds *= e
    dt = (ds @ h).reshape(-1, d)
    dh = ds.transpose(0, 2, 1) @ t
    dh += e.transpose(0, 2, 1) @ own
    scale = np.float32(d**-0.5)
    dh[:, since:] += (dz + dt @ ((p["Wk"] @ p["Wq"].T) * scale)).reshape(many, -1, d)
    both = (late.T @ dt) * scale
    de = np.zeros_like(p["E"])
    order = np.argsort(x.astype(np.min_scalar_type(len(de))), axis=None, kind="stable")
    met, first = np.unique(x.ravel()[order], return_index=True)
    de[met] = np.add.reduceat(dh.reshape(-1, d)[order], first, axis=0)
    dp = np.zeros_like(p["P"])
    dp[:size] = dh.sum(axis=0)
    g = {"E": de, "P": dp, "Wq": both @ p["Wk"], "Wk": both.T @ p["Wq"], "Wv": u.T @ dz, "Wo": z.T @ dl, "b": dl.sum(axis=0)}
    return loss, g


class Adam:
    def __init__(self, params: dict, rate: float):
        self.params, self.rate, self.steps = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, g: dict) -> None:
        """One step down ``g``, whose arrays are used up."""
        self.steps += 1
        fix = np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, x in self.params.items():
            m, v, new = self.m[k], self.v[k], g[k]
            m *= 0.9
            m += 0.1 * new
            v *= 0.99
            new *= new
            new *= 0.01
            v += new
            np.sqrt(v, out=new)
            new += 1e-7
            np.divide(m, new, out=new)
            new *= self.rate * fix
            x -= new


def packed(params: dict) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unpacked(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


# --- ids -----------------------------------------------------------------------------------


class Subwords(dict):
    """Ids of a word (after a space) as bytes of little-endian unsigned 16-bit numbers.

    Remembered in two generations of bounded size, so frequent words stay known.
    """

    LIMIT = 250_000

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.older: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        distinct = set(words)
        new = [w for w in distinct if w not in self]
        if new and len(self) > self.LIMIT:
            self.older = dict(self)
            self.clear()
            new = list(distinct)
        self.update((w, self.older[w]) for w in new if w in self.older)
        plain = [w for w in new if w not in self.older]
        spelled = [" " + w.decode("utf-8", "replace") for w in plain]
        for word, found in zip(plain, self.tokenizer.encode_batch_fast(spelled, add_special_tokens=False)):
            self[word] = array("H", found.ids).tobytes()

    def ids(self, words: list[bytes]) -> np.ndarray:
        return spelled_ids(self.spelled(words))

    def spelled(self, words: list[bytes]) -> bytes:
        self.learn(words)
        return b"".join([self[w] for w in words])


@lru_cache(1)
def subwords(path: str) -> Subwords:
    """One for all tasks that a Python worker runs in a row, so words are not learned again in each."""
    return Subwords(path)


def spelled_ids(spelled: bytes) -> np.ndarray:
    return np.frombuffer(spelled, "<u2").astype(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """Of each id, and of the end at the last place: its class, input unit, log10 P(id | class)."""

    classes: np.ndarray
    units: np.ndarray
    within: np.ndarray
    path: str

    @property
    def end(self) -> int:
        return len(self.classes) - 1


def vocabulary(counts: np.ndarray, shape: Shape, path: str) -> Vocabulary:
    """Classes of about equal mass by falling count; frequent ids have a unit of their own."""
    smooth = counts + 0.5
    order = np.lexsort((np.arange(len(counts)), -counts))
    mass = np.cumsum(smooth[order]) / smooth.sum()
    classes = np.empty(len(counts), np.int64)
    classes[order] = np.minimum((mass - 1e-12) * shape.classes, shape.classes - 1).astype(np.int64)
    total = np.bincount(classes, smooth, shape.classes)
    units = shape.units + classes
    units[order[: shape.units]] = np.arange(min(shape.units, len(counts)))
    return Vocabulary(classes, units, np.log10(smooth / total[classes]), path)


def id_counts(training: DataFrame, path: str) -> np.ndarray:
    """How often each id, and the end at the last place, occurs in encoded texts (``ids``)."""
    size = Subwords(path).size

    def run(batches):
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            seen[:-1] += np.bincount(np.frombuffer(b"".join(raw(batch.column(0))), "<u2"), minlength=size)
            seen[-1] += batch.num_rows
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["id", "n"])

    out = np.zeros(size + 1)
    for r in training.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


# --- windows -------------------------------------------------------------------------------


def windows(length: int, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows over ``length`` places, and from which place of each on it scores."""
    stride = size - overlap
    n = 1 + max(0, -(-(length - size) // stride))
    return np.arange(n) * stride, np.r_[0, np.full(n - 1, overlap)]


@dataclass(frozen=True)
class Cut:
    """Windows of texts. ``flat``: of each text a begin (-1), its ids, and the end; the others: of
    each window its text, its number there, its start, its text's end."""

    flat: np.ndarray
    owners: np.ndarray
    numbers: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def rows(self, which: np.ndarray, vocab: Vocabulary, shape: Shape, since: int, until: int) -> tuple[np.ndarray, ...]:
        """Of the places before ``until`` of windows: input units; from ``since`` on: the ids that follow, and whether any does."""
        ends = self.ends[which, None]
        places = np.minimum(self.starts[which, None] + np.arange(until), ends)
        before, late = self.flat[places], places[:, since:]
        x = np.where(before < 0, shape.units + shape.classes, vocab.units[before])
        return x, self.flat[np.minimum(late + 1, ends)], late < ends

    def parts(self, which: np.ndarray, shape: Shape) -> list[tuple[np.ndarray, int, int]]:
        """Windows, since, until: the places that windows have of their own. Those before ``overlap``
        are a text's first window's; nothing is computed for places that another window has."""
        halves = [(which[self.numbers[which] == 0], 0, shape.overlap), (which, shape.overlap, shape.window)]
        return [(w[self.starts[w] + since < self.ends[w]], since, until) for w, since, until in halves]


def cut(docs: list[np.ndarray], vocab: Vocabulary, shape: Shape) -> Cut:
    """All windows of the texts' ids; each id and each end follows a place of one window's own."""
    lengths = np.array([len(ids) + 2 for ids in docs])
    bases = np.cumsum(lengths) - lengths
    each = [windows(n - 1, shape.window, shape.overlap)[0] for n in lengths.tolist()]
    many = [len(s) for s in each]
    owners = np.repeat(np.arange(len(docs)), many)
    return Cut(
        np.concatenate([part for ids in docs for part in ([-1], ids, [vocab.end])]).astype(np.int64),
        owners,
        np.concatenate([np.arange(n) for n in many]),
        np.concatenate(each) + bases[owners],
        (bases + lengths - 1)[owners],
    )


# --- training ------------------------------------------------------------------------------


def taken(keys: np.ndarray, numbers: np.ndarray, turn: int, shape: Shape) -> np.ndarray:
    """Whether a round reads a window, by its text's key and its number; any ``every`` rounds in a row read each once."""
    return (keys + numbers + turn) % shape.every == 0


def learned(batches, vocab: Vocabulary, start: dict, turn: int, shape: Shape) -> tuple[dict, int]:
    """A task's copy of the network after one pass over its windows of a round, and how many targets these had.

    Batches have a text's key, and its ids (binary) or itself."""
    known = None
    adam = Adam({k: v.copy() for k, v in start.items()}, shape.rate)
    waiting: dict[int, list[tuple]] = {0: [], shape.overlap: []}  # by their first place
    weight = 0

    def learn(rows: tuple, since: int) -> None:
        nonlocal weight
        x, after, valid = rows
        adam.step(gradients(adam.params, x, vocab.classes[after], valid, since)[1])
        weight += int(valid.sum())

    for batch in batches:
        keys, bodies = batch.column(0).to_numpy(), raw(batch.column(1))
        if pa.types.is_binary(batch.column(1).type) or pa.types.is_large_binary(batch.column(1).type):
            ids_of = spelled_ids
        else:
            known = known or Subwords(vocab.path)
            ids_of = lambda b: known.ids(b.lower().split())
        for at in range(0, len(bodies), 256):
            windowed = cut([ids_of(b) for b in bodies[at : at + 256]], vocab, shape)
            mine = np.flatnonzero(taken(keys[at : at + 256][windowed.owners], windowed.numbers, turn, shape))
            for which, since, until in windowed.parts(mine, shape):
                for first in range(0, len(which), 16 * shape.batch):
                    rows = windowed.rows(which[first : first + 16 * shape.batch], vocab, shape, since, until)
                    rows = tuple(map(np.concatenate, zip(*waiting[since], rows)))
                    full = len(rows[0]) // shape.batch * shape.batch
                    for k in range(0, full, shape.batch):
                        learn(tuple(r[k : k + shape.batch] for r in rows), since)
                    waiting[since] = [tuple(r[full:] for r in rows)]
    for since, rest in waiting.items():
        if rest and len(rest[0][0]):
            learn(rest[0], since)
    return adam.params, weight


def trained(docs: DataFrame, vocab: Vocabulary, shape: Shape) -> dict:
    """Rounds of local training and averaging; ``docs`` has key and ids of training rows."""
    spark = docs.sparkSession
    like = initial(shape)
    params = like
    for turn in range(shape.rounds):
        shared = spark.sparkContext.broadcast((vocab, params))

        def run(batches, turn=turn, shared=shared):
            vocab, start = shared.value
            params, weight = learned(batches, vocab, start, turn, shape)
            if weight:
                vector = packed(params).astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([vector], pa.binary()), pa.array([float(weight)])], ["vector", "weight"]
                )

        def averaged(rows: pd.DataFrame) -> pd.DataFrame:
            weight = rows["weight"].sum()
            total = sum(np.frombuffer(v, "<f4").astype(float) * w for v, w in zip(rows["vector"], rows["weight"]))
            return pd.DataFrame({"vector": [(total / weight).astype("<f4").tobytes()], "weight": [weight]})

        schema = "vector binary, weight double"
        copies = docs.select("key", "ids").mapInArrow(run, schema)
        part = F.pmod(F.spark_partition_id(), F.lit(max(1, int(docs.rdd.getNumPartitions() ** 0.5))))
        some = copies.withColumn("part", part).groupBy("part").applyInPandas(lambda r: averaged(r), schema)
        last = some.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(lambda r: averaged(r), schema).collect()
        if last:
            params = unpacked(np.frombuffer(bytes(last[0]["vector"]), "<f4"), like)
    return params


# --- scoring -------------------------------------------------------------------------------


def log10_probabilities(docs: list[np.ndarray], vocab: Vocabulary, params: dict, shape: Shape, batch: int = 256) -> np.ndarray:
    """log10 probability of each text's ids and its end."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    windowed = cut(docs, vocab, shape)
    for mine, since, until in windowed.parts(np.arange(len(windowed.starts)), shape):
        for at in range(0, len(mine), batch):
            which = mine[at : at + batch]
            x, after, valid = windowed.rows(which, vocab, shape, since, until)
            each = of_classes(params, x, vocab.classes[after], since) / np.log(10) + vocab.within[after]
            out += np.bincount(windowed.owners[which], np.where(valid, each, 0).sum(axis=1), len(docs))
    return out


def counted(training: DataFrame, limit: int = 300_000) -> DataFrame:
    """word, c over training texts; the end is the empty word."""

    def run(batches):
        seen = Counter()
        for batch in batches:
            for body in raw(batch.column(0)):
                seen.update(body.lower().split())
                seen[END_WORD] += 1
                if len(seen) > limit:
                    yield flushed(seen)
                    seen = Counter()
        yield flushed(seen)

    def flushed(seen):
        return pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"]
        )

    made = training.select("text").mapInArrow(run, "word binary, c bigint")
    return made.groupBy("word").agg(F.sum("c").alias("c"))


def head_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """All words at or above a frequency, chosen so that they are at most ``most``."""
    bin_of = F.floor(F.log2("c") * 8).cast("int")
    bins = counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    total, least = 0, None
    for r in sorted(bins, reverse=True):
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    if least is None:
        return {}
    return {bytes(r["word"]): r["c"] for r in counts.where(F.col("c") >= least).collect()}


def score(docs: DataFrame, path: str, shape: Shape = Shape(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    bare = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bare = bare.withColumn("held_out", crc % 7 == 2).withColumn("key", crc)
    training = bare.where("not held_out")
    counts = pin(counted(training))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"]), int(sums["v"])
    head = head_words(counts, shape.head)
    shared = docs.sparkSession.sparkContext.broadcast({w: (c, float(np.log10(c + 1))) for w, c in head.items()})

    def encode(batches):
        head, known = shared.value, subwords(path)
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out, words_left, counts_left, ends = [], [], [], [0]
            for doc, body in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                words = body.lower().split()
                n_known, logs = 0, 0.0
                for word, n in [*Counter(words).items(), (END_WORD, 1)]:
                    found = head.get(word)
                    if found is None:
                        words_left.append(word)
                        counts_left.append(n)
                    else:
                        n_known += n
                        logs += n * found[1]
                ends.append(len(words_left))
                row = xxhash.xxh3_64_intdigest(body, zlib.crc32(str(doc).encode())) >> 1
                out.append((row, len(words) + 1, n_known, logs, known.spelled(words)))
            arrays = [pa.array(x, t) for x, t in zip(zip(*out), _TYPES)]
            tail = pa.StructArray.from_arrays([pa.array(words_left, pa.binary()), pa.array(counts_left, pa.int64())], ["word", "n"])
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *arrays, tail], _NAMES)

    encoded = pin(bare.select("doc_id", "text", "held_out", F.col("key").alias("turn")).mapInArrow(encode, _ENCODED))
    learning = encoded.where("not held_out").select(F.col("turn").alias("key"), "ids")
    vocab = vocabulary(id_counts(learning, path), shape, path)
    model = docs.sparkSession.sparkContext.broadcast((vocab, trained(learning, vocab, shape)))

    def probable(batches):
        vocab, params = model.value
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            scores = log10_probabilities([spelled_ids(b) for b in raw(batch.column(0))], vocab, params, shape)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], _SCORED)

    kept = [c for c in _NAMES if c in _SCORED]
    schema = encoded.select(*kept).schema.add("score", "double")
    scored = pin(encoded.select("ids", *kept).mapInArrow(probable, schema))
    tail = scored.select("key", F.explode("tail").alias("t")).select("key", "t.word", "t.n")
    met = tail.join(counts, "word").groupBy("key", "word").agg(F.max("n").alias("n"), F.first("c").alias("c"))
    rest = met.groupBy("key").agg(
        F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_logs")
    )
    norm = float(np.log10(total + distinct + 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(rest, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("tail_known")).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + zero("tail_logs") - F.col("n_tokens") * norm).alias("base_score"),
        "score",
    )


_ENCODED = (
    "doc_id bigint, held_out boolean, turn bigint, key bigint, n_tokens bigint, n_known bigint, logs double, "
    "ids binary, tail array<struct<word:binary,n:bigint>>"
)
_NAMES = ["doc_id", "held_out", "turn", "key", "n_tokens", "n_known", "logs", "ids", "tail"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
_SCORED = ["doc_id", "held_out", "key", "n_tokens", "n_known", "logs", "tail", "score"]
