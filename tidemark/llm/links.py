"""Components of similar sets, from groups whose members may be similar.

Members of a group are never compared as all pairs at once. Each round a group tests a few
centres against its other members, confirmed links are joined to components by union-find,
groups that fell into one component are done, and tested centres leave their group. A pair
that shares a group is thus tested or already connected.

What is tested is filtered without loss first: a set carries one bit per residue of its
elements' hashes, the parity of how many elements have that residue. Two sets differ in at
least as many elements as their parities differ in bits, so pairs whose parities differ in
more than similarity allows are left out. As each further round has ``centres`` times as many
centres, a member meets about ``centres`` of its own, still unconnected likes a round.

Joins on a group's key are plain equi-joins, which Spark splits where one key is hot.
Components live in tables; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import raw
from tidemark.session import pin

#: Least parity bits of a set, in 64-bit numbers.
WORDS = 10

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one.
LONG_WORD = 128
_MASKS = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Of each text its words' 64-bit hashes; words hold no space.

    All words of all texts take eight bytes a step together, and no word is remembered: the words of
    large inputs are too many for that.
    """
    joined = b" ".join(w for words in texts for w in words)
    size = len(joined)
    joined += bytes(8)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8, size) == 32)
    many = np.array([len(words) for words in texts], np.int64)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, size]
    if not many.sum():
        starts = ends = starts[:0]
    eights = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), 8)
    lengths = ends - starts
    out = lengths.astype(np.uint64)
    rows, at = np.arange(len(starts)), 0
    while len(rows) and at < LONG_WORD:
        part = eights[starts[rows] + at].view("<u8").ravel() & _MASKS[np.minimum(lengths[rows] - at, 8)]
        out[rows] = mixed(out[rows] * MIX[0] + part)
        at += 8
        rows = rows[lengths[rows] > at]
    for k in rows.tolist():
        out[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
    return np.split(out, np.cumsum(many)[:-1])[: len(texts)]


def shingles(each: np.ndarray, size: int) -> np.ndarray:
    """The shingle hashes of a text's word hashes, in their order."""
    if not len(each):
        return np.empty(0, np.uint64)
    size = min(size, len(each))
    out = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * MIX[0] + each[k : len(each) - size + 1 + k])
    return out


def shingle_set(each: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    return np.unique(shingles(each, size))


def shingle_sets(bodies: list[bytes], size: int) -> list[np.ndarray]:
    """The shingle sets of lower-cased texts."""
    return [shingle_set(each, size) for each in word_hashes([b.lower().split() for b in bodies])]


def parity(elements: np.ndarray, words: int | None = None) -> np.ndarray:
    """Bit r of the result: whether an odd number of elements has the residue r.

    There are at least as many residues as elements, by doubling from ``WORDS`` * 64.
    """
    if words is None:
        words = WORDS
        while 64 * words < len(elements):
            words *= 2
    at = (elements % np.uint64(64 * words)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


#: Parity words that groups carry in the first round and later, when few groups are left.
FIRST_WORDS, LATER_WORDS = 2, WORDS


def _hints(words: int) -> list[str]:
    return ["n_shingles", *(f"hint_{k}" for k in range(words))]


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def folded(bits: Column, words: int = FIRST_WORDS) -> list[Column]:
    """The parity by residues of 64 * ``words``, which divide the longer one's."""
    zero = F.lit(0).cast("bigint")
    return [F.aggregate(F.filter(bits, lambda _, i: i % words == k), zero, _xor) for k in range(words)]


def halved(bits: Column, size: Column) -> Column:
    """The parity by half as many residues, where it is longer than ``size``."""
    half = (F.size(bits) / 2).cast("int")
    return F.when(F.size(bits) > size, F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), _xor)).otherwise(bits)


def possible(n: Column, m: Column, unlike: Column, percent: int) -> Column:
    """Whether sets of these sizes whose parities differ in so many bits may reach the
    similarity; never false if they do."""
    fits = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return fits & (unlike * (100 + percent) <= (100 - percent) * (n + m))


def by_hints(percent: int, words: int = FIRST_WORDS) -> Column:
    """``possible`` for a member and a centre (``c_``) by their sizes and folded parities."""
    unlike = F.lit(0)
    for h in _hints(words)[1:]:
        unlike = unlike + F.bit_count(_xor(F.col(h), F.col(f"c_{h}")))
    return possible(F.col("n_shingles"), F.col("c_n_shingles"), unlike, percent)


def likely(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole parities allow the similarity; ``parities`` has node,
    n_shingles, bits."""
    for x in ("a", "b"):
        pairs = pairs.join(parities.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    one, two = F.col("bits_a"), F.col("bits_b")
    size = F.least(F.size(one), F.size(two))
    for _ in range(3):  # similar sets differ little in size, hence in doublings
        one, two = halved(one, size), halved(two, size)
    differ = F.zip_with(one, two, lambda x, y: F.bit_count(_xor(x, y)))
    unlike = F.when(F.size(one) == F.size(two), F.aggregate(differ, F.lit(0), lambda s, x: s + x)).otherwise(0)
    return pairs.where(possible(F.col("n_a"), F.col("n_b"), unlike, percent)).select("a", "b")


#: Documents up to which a list of them travels to the texts instead of meeting them in a shuffle.
FEW_NODES = 500_000


def sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and its full set, for ``nodes``; ``classes`` says which document holds the set of
    which node (node, set_key, low)."""

    def run(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            found, sets = [], []
            for node, key, own in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(raw(batch.column(2)), shingle)
            ):
                if xxhash.xxh3_128_digest(own.tobytes()) == key:
                    found.append(node)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"]
            )

    held = pin(classes.join(nodes, "node", "left_semi").select("node", "set_key", F.col("low").alias("doc_id")))
    held = F.broadcast(held) if held.count() <= FEW_NODES else held
    rows = docs.join(held, "doc_id").select("node", "set_key", "text")
    made = rows.mapInArrow(run, "node bigint, shingles array<bigint>")
    return pin(made.groupBy("node").agg(F.first("shingles").alias("shingles")))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar, with the shared elements."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = sets_of(docs, classes, nodes, shingle)
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("a", "b"))
    sized = pairs.join(right, "b").join(left, "a").select(
        "a",
        "b",
        F.size(F.array_intersect("sa", "sb")).alias("shared"),
        (F.size("sa") + F.size("sb")).alias("sizes"),
    )
    return pin(sized.where(f"100 * shared >= {percent} * (sizes - shared)").select("a", "b", "shared"))


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root) after joining what ``edges`` (a, b) connect.

    Each round every root takes the least root an edge leads to and follows two more such
    hooks; a star of any size is done in one round, and chains shrink by a factor a round. Edges
    lead across as long as their ends have different roots, so nothing is done too early.
    """
    while True:
        ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
        across = edges.join(ra, "a").join(rb, "b").where("ra <> rb")
        across = across.select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("lower"))
        hooks = pin(across.groupBy("root").agg(F.min("lower").alias("lower")))
        if hooks.isEmpty():
            return roots
        up = hooks.select(F.col("root").alias("lower"), F.col("lower").alias("next"))
        for _ in range(2):
            hooks = hooks.join(up, "lower", "left").select("root", F.coalesce("next", "lower").alias("lower"))
        roots = pin(roots.join(hooks, "root", "left").select("node", F.coalesce("lower", "root").alias("root")))


def _tested(pairs: DataFrame, roots: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``roots`` after the links among ``pairs``, (a, b) with a centre b.

    Every member first tests one of its centres, by an order all share, so that most pairs
    are connected before their sets are fetched; those of the others that still lie in
    different components are then tested together.
    """
    if pairs.isEmpty():
        return roots
    picked = pin(pairs.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("b")))
    roots = joined(roots, verify(picked))
    ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
    rest = pairs.join(picked, ["a", "b"], "left_anti").join(ra, "a").join(rb, "b").where("ra <> rb")
    rest = pin(rest.select("a", "b"))
    return roots if rest.isEmpty() else joined(roots, verify(rest))


def _several(groups: DataFrame) -> DataFrame:
    """Groups with members of more than one component."""
    ends = groups.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return pin(groups.join(ends.where("low < high").select("key"), "key"))


def hinted(groups: DataFrame, parities: DataFrame, words: int = FIRST_WORDS) -> DataFrame:
    """``groups`` with sizes and folded parities."""
    sized = parities.select("node", "n_shingles", *(h.alias(f"hint_{k}") for k, h in enumerate(folded(F.col("bits"), words))))
    return groups.join(sized, "node")


def central(groups: DataFrame) -> DataFrame:
    """``groups`` (key, node, length) with ``met``: how many members a node meets in all its groups.

    Altered copies of one text share more groups with the text than with each other.
    """
    met = groups.groupBy("node").agg(F.sum("length").alias("met"))
    return groups.drop("length").join(met, "node")


def connected(
    groups: DataFrame,
    roots: DataFrame,
    parities: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    percent: int,
    centres: int,
    both_over: int = 0,
) -> DataFrame:
    """``roots`` (node, root) after all links within ``groups`` (key, node, and the key's length).

    ``parities`` has node, n_shingles and bits; groups carry the folded parity, a longer one as
    soon as there are several centres, and pairs it lets through are looked at by the whole one.
    ``verify`` returns the links among pairs
    (a, b). The first round tests one centre per group, by an order all groups share, so that
    the groups of one family test the same pairs: whoever meets most members goes first, as the
    text that others are altered copies of does, which links all of them at once. Pairs of which
    no set is larger than ``both_over`` are left out.
    """
    groups, slots, words = pin(hinted(central(groups), parities).join(roots, "node")), 1, FIRST_WORDS
    while not groups.isEmpty():
        slot = F.pmod(F.xxhash64(F.lit(slots), "node"), F.lit(slots))
        own = ["node", *_hints(words), "root"]
        chosen = pin(
            groups.groupBy("key", slot.alias("slot"))
            .agg(F.max_by(F.struct(*own), F.struct("met", F.xxhash64("node"))).alias("c"))
            .select("key", *(F.col(f"c.{x}").alias(f"c_{x}") for x in own))
        )
        over = F.greatest("n_shingles", "c_n_shingles") > both_over
        near = (F.col("root") != F.col("c_root")) & over & by_hints(percent, words)
        met = groups.join(chosen, "key").where(near)
        pairs = pin(likely(met.select(F.col("node").alias("a"), F.col("c_node").alias("b")).distinct(), parities, percent))
        roots = _tested(pairs, roots, verify)
        done = chosen.select("key", F.col("c_node").alias("node"))
        left = groups.drop("root").join(done, ["key", "node"], "left_anti")
        groups = _several(left.join(roots, "node"))
        if words < LATER_WORDS:
            words = LATER_WORDS
            groups = pin(hinted(groups.select("key", "node", "met", "root"), parities, words))
        slots *= centres
    return roots
