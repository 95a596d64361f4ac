"""N-gram Jaccard join: subsets for light sets, inverted lists for heavy ones.

A document's set is its distinct ``shingle``-word shingles as 64-bit hashes; documents with
equal sets are one class with one representative. Sets of at most ``boundary`` elements are
light, the others heavy.

* Light with light: sets of n and m elements are similar exactly if they share a subset of
  ``needed(n, m)`` elements. Every light set lists its subsets of the few sizes that any
  partner may need. The sets that list one subset are linked to the smallest of them: whoever
  may link by this subset may also link to the smallest, so a star loses nothing, and each of
  its links is exact.
* All others: elements are ordered by rarity: those far more frequent than others by a sketch of
  fixed size come last, the others go by how common their words are. Any common order is right,
  this one keeps frequent elements out of the lists. A set is in the lists of
  its first n - ceil(n * similarity) + 1 elements, and similar sets meet in one of them. Heavy
  sets scan their lists; members are filtered by size and parity without loss, tested by
  centres (see ``links``), and every link is confirmed on the full sets.

The boundary is chosen by cost: for every size the subsets its sets would list against the
members their lists hold, from the counts of this very input.

* Null, empty or blank text: empty set, linked with nothing, its own component.
* Fewer words than a shingle: the whole sequence is the one shingle.
* Every row is a document, repeated rows too; rows with a null id are linked with nothing.
* Columns besides the two named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import links
from tidemark.llm.common import raw, texts
from tidemark.session import pin

#: Largest size whose subsets may be listed; the cost decides up to here.
LIGHTEST = 30
#: Members of an inverted list that cost as much as one listed subset.
SCANNED = 10
_BUCKET_BITS, _BLOCK_BITS = 20, 14
#: Levels of a bucket's count from one power of two to the next.
LEVELS = 8


def needed(n: int, m: int, percent: int) -> int:
    """Elements that sets of n and m elements must share to be similar."""
    return -(-percent * (n + m) // (100 + percent))


@lru_cache(None)
def subset_sizes(n: int, percent: int) -> tuple[int, ...]:
    """Sizes of subsets by which a set of n elements may be linked to a set of any size."""
    sizes = (needed(n, m, percent) for m in range(-(-percent * n // 100), 100 * n // percent + 1))
    return tuple(sorted({r for r in sizes if r <= n}))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


@lru_cache(256)
def _left_out(n: int, r: int) -> np.ndarray:
    return np.array(list(combinations(range(n), r)), np.int64).reshape(comb(n, r), r)


_OTHER = np.uint64(0xA0761D6478BD642F)


def subset_keys(elements: np.ndarray, percent: int) -> list[np.ndarray]:
    """size and two sums of mixed hashes (128 bits) of every subset of the needed sizes."""
    n, out = len(elements), []
    sides = [links.mixed(elements), links.mixed(elements ^ _OTHER)]
    for size in subset_sizes(n, percent):
        gone = _left_out(n, n - size)
        keys = [side.sum(dtype=np.uint64) - side[gone].sum(axis=1, dtype=np.uint64) for side in sides]
        out.append(np.stack([np.full(len(gone), size, np.uint64), *keys]))
    return list(np.concatenate(out, axis=1)) if out else [np.empty(0, np.uint64)] * 3


@dataclass(frozen=True)
class Rarity:
    """Per bucket of hashes: of elements a level where they are far more than usual, of words how common they are."""

    crowded: np.ndarray
    common: np.ndarray

    def order(self, each: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
        """A text's set, sorted by hash, and its order from the rarest on, for the text's word hashes.

        Elements of crowded buckets come last. A sketch cannot tell the others apart once there are
        many more elements than buckets; their words can, which are far fewer than elements.
        """
        size = min(shingle, len(each))
        own, first = np.unique(links.shingles(each, shingle), return_index=True)
        words = self.common[_bucket(each)].astype(np.int64)
        score = sum((words[k : len(words) - size + 1 + k] for k in range(size)), np.zeros(len(words) - size + 1, np.int64))
        return own, np.lexsort((own, score[first] // LEVELS, self.crowded[_bucket(own)]))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


def rarity(docs: DataFrame, shingle: int) -> Rarity:
    """How often the elements of a bucket occur in sets, and the words of a bucket in texts.

    Tasks count in two tables of fixed size; their blocks are added up where they meet.
    """
    block, buckets = 1 << _BLOCK_BITS, 1 << _BUCKET_BITS

    def count(batches):
        tables = np.zeros((2, buckets), np.int64)
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), 256):  # the words of more texts would take much memory
                words = links.word_hashes([b.lower().split() for b in raw(column.slice(at, 256))])
                sets = [links.shingle_set(each, shingle) for each in words]
                for table, found in zip(tables, (sets, words)):
                    table += np.bincount(_bucket(np.concatenate(found)), minlength=buckets)
        blocks = tables.reshape(-1, block)
        for k in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blocks[k]], pa.list_(pa.int64()))], ["block", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = part.values.to_numpy()
                held[k] = held[k] + values if k in held else values
        for k, total in held.items():
            level = np.minimum(np.round(LEVELS * np.log2(total + 1.0)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "levels"])

    counted = docs.select("text").mapInArrow(count, "block int, counts array<bigint>").repartition("block")
    levels = np.zeros(2 * buckets, np.uint8)
    for r in counted.mapInArrow(add, "block int, levels binary").collect():
        levels[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["levels"], np.uint8)
    elements, words = levels.reshape(2, -1)
    return Rarity(np.where(elements > np.median(elements) + 2 * LEVELS, elements // LEVELS, 0).astype(np.uint8), words)


def described(docs: DataFrame, shingle: int, percent: int, rare: Rarity) -> DataFrame:
    """doc_id, n_shingles, set_key, prefix (rarest elements), bits (parity), few (a small set)."""

    def describe(batches):
        known = {}
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for at in range(0, len(column), 256):
                sizes, keys, found = [], [], []
                for each in links.word_hashes([b.lower().split() for b in raw(column.slice(at, 256))]):
                    own = links.shingle_set(each, shingle)
                    key = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                    sizes.append(len(own))
                    keys.append(key)
                    if key is None:
                        found.append((None, None, None))
                        continue
                    if key not in known:
                        if len(known) > 5_000:
                            known.clear()
                        order = rare.order(each, shingle)[1][: prefix_length(len(own), percent)]
                        few = own.view(np.int64) if len(own) <= LIGHTEST else None
                        known[key] = own[order].view(np.int64), links.parity(own), few
                    found.append(known[key])
                many = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + 256], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *(pa.array([f[k] for f in found], many) for k in range(3))],
                    ["doc_id", "n_shingles", "set_key", "prefix", "bits", "few"],
                )

    return docs.mapInArrow(
        describe, "doc_id bigint, n_shingles bigint, set_key binary, prefix array<bigint>, bits array<bigint>, few array<bigint>"
    )


def chosen_boundary(sizes: dict[int, tuple[int, int]], percent: int) -> int:
    """The cheapest boundary; ``sizes`` gives sets and list members to scan per size."""
    best, least = 0, None
    for x in range(LIGHTEST + 1):
        listed = sum(n * sum(comb(size, r) for r in subset_sizes(size, percent)) for size, (n, _) in sizes.items() if size <= x)
        scanned = sum(members for size, (_, members) in sizes.items() if x < size <= LIGHTEST)
        cost = SCANNED * listed + scanned
        if least is None or cost < least:
            best, least = x, cost
    return best


def light_links(classes: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Links (a, b) between light sets: stars that connect all that are similar."""

    def enumerate_(batches):
        for batch in batches:
            for node, few in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = few.values.to_numpy().view(np.uint64)
                size, one, two = subset_keys(own, percent)
                n = len(size)
                arrays = [pa.array(np.full(n, node, np.int64)), pa.array(np.full(n, len(own), np.int32)), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["node", "n", "size", "one", "two"]
                )

    small = classes.where(F.col("n_shingles") <= boundary).select("node", "few")
    listed = pin(small.mapInArrow(enumerate_, "node bigint, n int, size int, one bigint, two bigint"))
    key = ["size", "one", "two"]
    stars = listed.groupBy(key).agg(F.min(F.struct("n", "node")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    need = F.ceil(percent * (F.col("n") + F.col("hub.n")) / F.lit(100 + percent))
    met = listed.join(stars, key).where((F.col("node") != F.col("hub.node")) & (need <= F.col("size")))
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """key, node, n_shingles, length of inverted lists with members that may be similar.

    Sets whose first common element stands at places i and j share at most min(n - i, m - j)
    elements. In a list of two that is asked of the two; they may still meet in another one.
    """
    posted = classes.select("node", "n_shingles", F.posexplode("prefix").alias("place", "key"))
    counts = [F.count("*").alias("length"), F.sum("n_shingles").alias("sizes"), F.min(F.col("n_shingles") - F.col("place")).alias("most")]
    several = posted.groupBy("key").agg(*counts).where(f"length > 2 or (length = 2 and most * {100 + percent} >= {percent} * sizes)")
    return posted.drop("place").join(several.select("key", "length"), "key")


def _parts(docs: DataFrame, shingle: int, percent: int):
    """Described rows, classes, inverted lists and the boundary."""
    signed = pin(described(docs, shingle, percent, rarity(docs, shingle)))
    usable = signed.where("set_key is not null and doc_id is not null")
    same = [F.first(c).alias(c) for c in ("n_shingles", "prefix", "bits", "few")]
    classes = pin(usable.groupBy("set_key").agg(F.min("doc_id").alias("low"), *same).withColumn("node", F.monotonically_increasing_id()))
    lists = pin(_lists(classes, percent))
    n = F.col("n_shingles") <= LIGHTEST
    scans = {r[0]: r[1] for r in lists.where(n).groupBy("n_shingles").agg(F.sum("length")).collect()}
    sizes = {r[0]: (r[1], scans.get(r[0], 0)) for r in classes.where(n).groupBy("n_shingles").count().collect()}
    boundary = chosen_boundary(sizes, percent)
    # a set is scanned for by heavy ones only if it can be similar to one
    lists = lists.where(100 * F.col("n_shingles") >= percent * (boundary + 1))
    return signed, classes, lists, boundary


def _bare(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def join(
    docs: DataFrame, shingle: int = 3, percent: int = 90, centres: int = 32, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), one row per row.

    Documents link where 100 * intersection >= percent * union of their shingle sets.
    """
    bare = _bare(docs, doc_id, text)
    signed, classes, lists, boundary = _parts(bare, shingle, percent)
    roots = links.joined(pin(classes.select("node", F.col("node").alias("root"))), pin(light_links(classes, percent, boundary)))
    verify = lambda found: links.verified(found, bare, classes, shingle, percent)
    roots = links.connected(lists.select("key", "node", "length"), roots, classes, verify, percent, centres, both_over=boundary)
    member = classes.join(roots, "node").select("set_key", "low", "root")
    component = member.join(member.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    found = signed.where("set_key is not null and doc_id is not null").select("doc_id", "n_shingles", "set_key")
    out = found.join(component.select("set_key", "component_id"), "set_key").drop("set_key")
    alone = signed.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def pairs(docs: DataFrame, shingle: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and who has which set.

    Links are (a, b, shared, n_a, n_b) between the least ids of two sets, a < b; members are
    (doc_id, representative). The result is as large as there are links.
    """
    bare = _bare(docs, doc_id, text)
    signed, classes, lists, _ = _parts(bare, shingle, percent)
    groups = pin(links.hinted(classes.select("node", F.explode("prefix").alias("key")), classes))
    other = groups.select("key", *(F.col(c).alias(f"c_{c}") for c in groups.columns if c != "key"))
    near = (F.col("node") < F.col("c_node")) & links.by_hints(percent)
    met = groups.join(other, "key").where(near).select(F.col("node").alias("a"), F.col("c_node").alias("b")).distinct()
    found = links.verified(pin(links.likely(met, classes, percent)), bare, classes, shingle, percent)
    one, two = (classes.select(F.col("node").alias(x), F.col("low").alias(f"low_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab")
    named = found.join(one, "a").join(two, "b")
    turned = F.col("low_a") < F.col("low_b")
    ends = [F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"), "shared"]
    sizes = [F.when(turned, F.col(f"n_{x}")).otherwise(F.col(f"n_{y}")).alias(f"n_{x}") for x, y in ("ab", "ba")]
    members = signed.where("doc_id is not null").join(classes.select("set_key", "low"), "set_key", "left")
    return named.select(*ends, *sizes), members.select("doc_id", F.coalesce("low", "doc_id").alias("representative"))
