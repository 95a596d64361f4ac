"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find.

A document's set is its distinct ``shingle``-word shingles as 64-bit hashes. Documents with
equal sets become one representative. SuperMinHash gives each shingle a random permutation of
the signature's places, rank by rank; a place keeps the least rank plus fraction that meets
it. The ranks of one shingle are correlated, which lowers the variance against independent
minima, and a document stops as soon as the next rank cannot lower any place.

Signatures are cut in bands. Documents that share a band are candidates, but never as all
pairs: ``links`` tests centres of every band group against its members, after a filter by size
and parity that loses nothing; every link is confirmed on the full sets, recomputed from the
texts, and union-find joins them to components.

With 32 bands of 6 places a pair of similarity 0.85 is missed with a chance of 3e-7.

Only ids, band hashes, parities and the sets of candidates are exchanged.

* Null, empty or blank text: empty set, linked with nothing, its own component, kept.
* Fewer words than a shingle: the whole sequence is the one shingle.
* Every row is a document, repeated rows too; rows with a null id are linked with nothing and kept.
* Very long texts are hashed in chunks of shingles. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import raw, texts
from tidemark.llm.links import MIX, connected, mixed, parity, shingle_sets, verified
from tidemark.session import pin

BANDS, ROWS = 32, 6


def super_minhashes(sets: list[np.ndarray], places: int, chunk: int = 16_384) -> np.ndarray:
    """One signature of ``places`` floats per set: least rank + fraction per place.

    Elements of many sets go through the ranks together, at most ``chunk`` at a time; those
    of a set whose places are all below the rank have stopped.
    """
    signatures = np.full((len(sets), places), np.inf)
    flat = signatures.reshape(-1)
    elements = np.concatenate([*sets, np.empty(0, np.uint64)])
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(elements), chunk):
        state, owner = elements[at : at + chunk], owners[at : at + chunk]
        order = np.tile(np.arange(places, dtype=np.int16), len(state))
        base = np.arange(len(state)) * places
        first, last = owner[0], owner[-1] + 1
        for rank in range(places):
            open_ = signatures[first:last].max(axis=1)[owner - first] > rank
            if not open_.all():
                state, owner, base = state[open_], owner[open_], base[open_]
                if not len(state):
                    break
            state = mixed(state + MIX[0])
            fraction = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
            state = mixed(state + MIX[0])
            other = base + rank + ((state >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
            picked = order[other]
            order[other] = order[base + rank]
            order[base + rank] = picked
            np.minimum.at(flat, owner * places + picked, rank + fraction)
    return signatures


def super_minhash(elements: np.ndarray, places: int, chunk: int = 16_384) -> np.ndarray:
    return super_minhashes([elements], places, chunk)[0]


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * MIX[0] + bits[:, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (hash of the whole set), bands, bits (parity)."""

    def sign(batches):
        known = {}
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for at in range(0, len(column), 256):
                sets = shingle_sets(raw(column.slice(at, 256)), shingle)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                if len(known) > 5_000:
                    known.clear()
                new = {k: s for k, s in zip(keys, sets) if k is not None and k not in known}
                for key, signature in zip(new, super_minhashes(list(new.values()), bands * rows)):
                    known[key] = band_hashes(signature, bands, rows), parity(new[key])
                found = [known[k] if k is not None else ((), ()) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[at : at + 256],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array([f[0] for f in found], pa.list_(pa.int64())),
                        pa.array([f[1] for f in found], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands", "bits"],
                )

    return docs.mapInArrow(sign, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, bits array<bigint>")


def group(
    docs: DataFrame,
    shingle: int = 3,
    percent: int = 85,
    bands: int = BANDS,
    rows: int = ROWS,
    centres: int = 32,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable), kept (doc_id is that id).

    Documents are linked where 100 * intersection >= percent * union of their shingle sets.
    """
    bare = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = pin(signatures(bare, shingle, bands, rows))
    usable = signed.where("set_key is not null and doc_id is not null")
    classes = pin(
        usable.groupBy("set_key")
        .agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    keyed = classes.select("node", F.posexplode("bands").alias("band", "value")).select(
        "node", F.xxhash64("band", "value").alias("key")
    )
    crowded = keyed.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    groups = pin(keyed.join(crowded, "key"))
    roots = pin(groups.select("node", F.col("node").alias("root")).distinct())
    verify = lambda pairs: verified(pairs, bare, classes, shingle, percent)
    roots = connected(groups, roots, classes, verify, percent, centres)
    member = classes.join(roots, "node", "left").select("set_key", "low", F.coalesce("root", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    component = member.join(least, "root").select("set_key", "component_id")
    alone = signed.where("set_key is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    out = usable.join(component, "set_key").unionByName(alone.select("set_key", *[c for c in alone.columns if c != "set_key"]))
    return out.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
