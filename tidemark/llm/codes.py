"""Product quantisation of vectors: Lloyd's algorithm whose members stay with their entry.

Every component becomes the integer floor(1024 * x), and a vector is cut into ``parts`` equal
consecutive parts. A part is a member of one codebook entry and is kept, as a row of its own,
by an owner (position, entry, salt); the salt deals a crowded entry to several owners.

* Placement: parts find their entry of the first codebook and are shuffled to its owners.
* Update: owners sum their resident members; one row per entry and task is exchanged, and
  the codebooks, ``parts`` * ``entries`` rows at any size, pass through the driver.
* Migration: residents look for their nearest new entry where they are. Those that keep their
  entry are written in place, without an exchange; only those that change it are shuffled to
  their new owners. The state of a round is what stayed and what arrived.

States are written to the shared folder, so a lost executor costs its running tasks only, and
deleted when the codebooks are final. Codes are then found from the vectors themselves.

All arithmetic is in integers, so results do not depend on how rows are dealt.

* A null vector, one with a null or non-finite component, or an empty one is dropped, and so
  is one whose length is not the most frequent (of several the least) or cannot be cut evenly.
* Distances tie to the lower index; unused entries keep their value.
* A repeated vec_id counts as often as it is there; a first codebook takes each id once, with
  the least of its vectors. A null vec_id is coded but starts no entry.
* Fewer ids than ``entries``: a smaller codebook. No ids at all: no rows.
* Components beyond +-65536 are taken as that bound, so that sums of squares stay exact.
* Other columns than the three named are ignored. Every label type that Spark can group works.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import named
from tidemark.operators.keyed import attach
from tidemark.session import pin, pins

SCALE, BOUND = 1024, 1 << 26
#: Up to this magnitude a product of two parts is exact in doubles.
_EXACT = 1 << 20

Codebooks = list[np.ndarray]


def integers(vectors: DataFrame, parts: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, x (integer components) of the vectors that can be coded."""
    bare = vectors.select(
        named(vec_id).cast("bigint").alias("vec_id"), named(label).alias("label"), named(vector).cast("array<double>").alias("v")
    )
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    bare = bare.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & sound)
    usual = bare.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return bare.select("vec_id", "label", F.lit(None).cast("array<int>").alias("x"))
    limit = float(BOUND)
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(limit)), F.lit(-limit)).cast("int"))
    return bare.where(F.size("v") == usual["n"]).select("vec_id", "label", whole.alias("x"))


def first_codebooks(coded: DataFrame, parts: int, entries: int) -> Codebooks:
    ids = coded.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    least = [r["vec_id"] for r in ids.collect()]
    if not least:
        return []
    found = coded.where(F.col("vec_id").isin(least)).groupBy("vec_id").agg(F.min("x").alias("x")).collect()
    start = np.array([r["x"] for r in sorted(found, key=lambda r: r["vec_id"])], np.int64)
    return np.split(start, parts, axis=1)


def nearest(members: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower one of equals, and the squared distance."""
    best, away = np.empty(len(members), np.int64), np.empty(len(members), np.int64)
    small = np.abs(codebook).max(initial=0) <= _EXACT
    for at in range(0, len(members), 4096):
        x = members[at : at + 4096]
        if small and np.abs(x).max(initial=0) <= _EXACT:
            f, c = x.astype(np.float64), codebook.astype(np.float64)
            far = (c * c).sum(axis=1) - 2 * (f @ c.T) + (f * f).sum(axis=1)[:, None]
        else:
            far = np.stack([((x - c) ** 2).sum(axis=1) for c in codebook], axis=1)
        best[at : at + 4096] = chosen = far.argmin(axis=1)
        away[at : at + 4096] = far[np.arange(len(x)), chosen].astype(np.int64)
    return best, away


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _rows(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(matrix.ravel().astype(np.int32))
    )


_MEMBER = "position int, entry int, salt int, part array<int>"


def _placed(coded: DataFrame, books: Codebooks, salts: int) -> DataFrame:
    """One row per part with its entry of the first codebook and a salt."""

    def place(batches):
        turn = 0
        for batch in batches:
            whole = _matrix(batch.column(0))
            if not len(whole):
                continue
            salt = (turn + np.arange(len(whole))) % salts
            turn += len(whole)
            for k, part in enumerate(np.split(whole, len(books), axis=1)):
                entry, _ = nearest(part, books[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), k, np.int32)), pa.array(entry.astype(np.int32)), pa.array(salt.astype(np.int32)), _rows(part)],
                    ["position", "entry", "salt", "part"],
                )

    return coded.select("x").mapInArrow(place, _MEMBER)


def _looking(state: DataFrame, books: Codebooks) -> DataFrame:
    """Residents with their nearest entry now and whether it is another than before."""

    def look(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            position, before = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = _matrix(batch.column(3))
            entry = before.copy()
            for k in np.unique(position):
                own = position == k
                entry[own] = nearest(parts[own], books[k])[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(entry), batch.column(2), batch.column(3), pa.array(entry != before)],
                ["position", "entry", "salt", "part", "moves"],
            )

    return state.select("position", "entry", "salt", "part").mapInArrow(look, _MEMBER + ", moves boolean")


def _updated(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at the floor of their resident members' mean."""
    width = books[0].shape[1]
    sums = [F.sum(F.get("part", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(width)]
    out = [b.copy() for b in books]
    for r in state.groupBy("position", "entry").agg(F.count("*").alias("n"), *sums).collect():
        out[r["position"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def _migrated(state: DataFrame, books: Codebooks) -> DataFrame:
    """The state after residents took their nearest entry: stayers in place, movers shuffled."""
    looked = pin(_looking(state, books))
    stay = looked.where("not moves").drop("moves")
    arrived = pin(looked.where("moves").drop("moves").repartition("position", "entry", "salt"))
    return stay.unionByName(arrived)


def fit(coded: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, members: int = 2_000) -> Codebooks:
    """Codebooks after ``rounds`` of assigning and updating; owners hold about ``members``."""
    books = first_codebooks(coded, parts, entries)
    if not books or not rounds:
        return books
    with pins(coded.sparkSession):
        salts = max(1, -(-coded.count() // members))
        state = pin(_placed(coded, books, salts).repartition("position", "entry", "salt"))
        for k in range(rounds):
            books = _updated(state, books)
            if k + 1 < rounds:
                state = _migrated(state, books)
    return books


def digest(books: Codebooks) -> str:
    """sha256 of all entries' components by part, entry and position within the part."""
    listed = ",".join(str(x) for b in books for x in b.ravel().tolist())
    return hashlib.sha256(listed.encode()).hexdigest()


def encode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, codes (entry per part), errors (squared distance per part)."""
    rows = coded.withColumn("row", F.struct("vec_id", "label"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            whole = _matrix(batch.column(1))
            if not len(whole):
                continue
            found = [nearest(p, b) for p, b in zip(np.split(whole, len(books), axis=1), books)]
            codes, errors = (np.stack([f[i] for f in found], axis=1) for i in (0, 1))
            ends = pa.array(np.arange(0, codes.size + 1, len(books)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _rows(codes), pa.ListArray.from_arrays(ends, pa.array(errors.ravel()))], ["row", "codes", "errors"]
            )

    out = rows.select("row", "x").mapInArrow(run, f"row {kind}, codes array<int>, errors array<bigint>")
    return out.select("row.*", "codes", "errors")


def compress(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that can be coded."""
    coded = integers(vectors, parts, vec_id, vector, label)
    books = fit(coded, parts, entries, rounds)
    sound = encode(coded if books else coded.limit(0), books)
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    total = F.aggregate("errors", F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = sound.select("vec_id", "label", hexed.alias("code"), total.alias("error"))
    rows = rows.withColumn("key", F.struct("label"))  # inside a struct nulls are equal
    joined = attach(rows, rows.groupBy("key").agg(F.sum("error").alias("label_error")), ["key"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
