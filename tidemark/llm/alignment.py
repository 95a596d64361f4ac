"""Alignment of two tokenizers over the same texts by pointer jumping.

Tokenizer A is a byte-level BPE of ``tokenizers``, B a BPE of ``sentencepiece`` with byte
fallback. Both cut a space and the text into tokens that tile its bytes. Every token points
to its farthest-right overlapping token of the other side, or to itself where none ends
farther right; doubling the successors (``to = to[to]``) until nothing changes leads every
token to the terminal token of its component, which labels its group. Groups thus end where
tokens of both sides end.

Both tokenizers always part before a space that follows and precedes other characters, and
around a line feed between such, and before a full stop or comma that ends a word, so texts
are cut there into chunks. The tokens of all chunks
that a task has not met lately are aligned together, as one vector of tokens; the aligned
chunks are remembered in two generations of bounded size.

One pass over the texts writes, per document, its numbers and its distinct linked id pairs
with their occurrences. Pairs are then counted, combined before they are shuffled. Pairs of at
least total / ``head`` documents, so at most ``head`` of them, travel to the documents; the
others, none of which can be hot, are joined.

* A null or empty text, one that holds U+2581, and one whose tokens of either side do not join
  to its bytes, have no tokens: zeros and ''.
* Every row is a document, repeated rows and null ids too. Strings of special tokens inside a
  text are plain text. Very long texts are cut into chunks like any; one without white space
  is a single chunk.
* Columns besides the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts
from tidemark.llm.packing import _OTHER, Encoder
from tidemark.session import pin

#: Pairs that travel with the documents, at most.
HEAD = 400_000
#: Chunks whose alignment one generation of a task's memory holds.
REMEMBERED = 160_000
#: An id pair as one number: A's id above, B's below.
_BITS = 16


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token of A and of B the terminal token of its component; both tile the same bytes.

    Tokens are numbered A first, then B.
    """
    n = len(a_ends)
    to = np.empty(n + len(b_ends), np.int64)
    over_a = np.searchsorted(b_ends, a_ends)  # the token of B over the last byte of A's
    over_b = np.searchsorted(a_ends, b_ends)
    to[:n] = n + over_a
    farther = a_ends[over_b] > b_ends
    to[n:] = np.where(farther, over_b, n + np.arange(len(b_ends)))
    while True:
        after = to[to]
        if np.array_equal(after, to):
            return to[:n], to[n:]
        to = after


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping tokens, as indexes into A and B in order."""
    starts = np.r_[0, a_ends[:-1]] if len(a_ends) else a_ends
    first, last = np.searchsorted(b_ends, starts, "right"), np.searchsorted(b_ends, a_ends)
    n = last - first + 1
    a = np.repeat(np.arange(len(a_ends)), n)
    return a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Aligner:
    """Aligned texts; see the module's text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as format_b

        self.cutter = Encoder(path_a)
        self.a = self.cutter.tokenizer
        self.a.encode_special_tokens = True
        self.a_size = np.zeros(self.a.get_vocab_size(), np.int64)
        for token, i in self.a.get_vocab().items():
            self.a_size[i] = len(token)  # byte-level: one character a byte
        model = format_b.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False  # the space is in front already
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        whole = [self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(w[3:5], 16)]) if self.b.is_byte(i) else w for i, w in enumerate(whole)]
        self.b_size = np.array([len(w) for w in self.b_bytes], np.int64)
        ids = [str(i) for i in range(max(len(self.a_size), len(self.b_size)))]
        self.shown = [np.array([i + mark for i in ids], object) for mark in "|;,"]
        # A full stop or comma after a letter or digit is a token of its own, but for those B joins.
        joined = {c for w in self.b_bytes for c in re.findall(r"([^\W_])[.,]", w.decode("utf-8", "ignore"))}
        self.mark = re.compile(rf"(?<=[^\W_{re.escape(''.join(joined))}])([.,])(?=[ \n]|\Z)")
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _sound(self, chunks: list[str], sides: list[list[list[int]]]) -> list[bool]:
        """Which chunks' tokens give their bytes on both sides."""
        bodies = [c.encode() for c in chunks]
        sizes = np.array([len(b) for b in bodies])
        flat = [np.fromiter((i for x in side for i in x), np.int64) for side in sides]
        tills = [np.cumsum([len(x) for x in side]) for side in sides]
        a_all, b_all = (np.diff(np.r_[0, np.r_[0, np.cumsum(size[ids])][till]]) for size, ids, till in zip((self.a_size, self.b_size), flat, tills))
        if (a_all == sizes).all() and (b_all == sizes).all() and b"".join([self.b_bytes[i] for i in flat[1].tolist()]) == b"".join(bodies):
            return [True] * len(chunks)
        return [
            n == len(body) and b"".join([self.b_bytes[i] for i in b]) == body
            for n, body, b in zip(a_all.tolist(), bodies, sides[1])
        ]

    def _aligned(self, chunks: list[str]) -> None:
        """Aligns chunks together and remembers (tokens of A, of B, groups, pairs, listing)."""
        sides = [[e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)], self.b.encode(chunks, num_threads=1)]
        sound = self._sound(chunks, sides)
        if not all(sound):
            self.known.update((c, None) for c, s in zip(chunks, sound) if not s)
            chunks, *sides = ([x for x, s in zip(xs, sound) if s] for xs in (chunks, *sides))
            if not chunks:
                return
        a_all, b_all = (np.fromiter((i for x in side for i in x), np.int64) for side in sides)
        a_till, b_till = (np.cumsum([len(x) for x in side]) for side in sides)
        a_ends, b_ends = np.cumsum(self.a_size[a_all]), np.cumsum(self.b_size[b_all])
        of_a, of_b = terminals(a_ends, b_ends)
        at_a, at_b = links(a_ends, b_ends)
        pairs = ((a_all[at_a] << _BITS) | b_all[at_b]).astype("<u4").tobytes()
        link_till = np.cumsum(np.bincount(at_a, minlength=len(a_all)))[a_till - 1]
        a_last, b_last = (np.r_[x[1:] != x[:-1], True] for x in (of_a, of_b))
        group_till = np.cumsum(a_last)[a_till - 1]
        # Ids with their separators, group by group: A's tokens, then B's.
        group = np.r_[np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last]
        text = np.r_[np.where(a_last, self.shown[0][a_all], self.shown[2][a_all]), np.where(b_last, self.shown[1][b_all], self.shown[2][b_all])]
        order = np.argsort(2 * group + np.r_[np.zeros(len(a_all), int), np.ones(len(b_all), int)], kind="stable")
        text = text[order].tolist()
        at = [0, 0, 0, 0]
        for chunk, *till in zip(chunks, a_till.tolist(), b_till.tolist(), group_till.tolist(), link_till.tolist()):
            m, n, groups, _ = (t - f for t, f in zip(till, at))
            listing = "".join(text[at[0] + at[1] : till[0] + till[1]])[:-1]
            self.known[chunk] = (m, n, groups, pairs[4 * at[3] : 4 * till[3]], listing)
            at = till

    def chunks(self, text: str) -> list[str]:
        """Parts that no token of either side reaches across."""
        if not _OTHER.search(text) and len(text.split()) == text.count(" ") + text.count("\n"):
            return self.mark.sub("\0\\1", text).replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return [c for chunk in self.cutter.chunks(text) for c in self.mark.sub("\0\\1", chunk).split("\0")] if "\0" not in text else [text]

    def align(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, str] | None]:
        """Per text ([tokens of A, of B, groups], pair of every link, listing of groups), or None."""
        cut = [list(filter(None, self.chunks(" " + t))) if t and "▁" not in t else [] for t in texts]
        met = set().union(*cut)
        new = met.difference(self.known)
        if new:
            if len(self.known) > REMEMBERED:
                self.older, self.known, new = self.known, {}, met
            held = {c for c in new if c in self.older}
            self.known.update((c, self.older[c]) for c in held)
            if fresh := list(new - held):
                self._aligned(fresh)
        out = []
        for chunks in cut:
            found = list(map(self.known.__getitem__, chunks))
            if not found or None in found:
                out.append(None)
                continue
            a, b, groups, pairs, listing = zip(*found)
            out.append(([sum(a), sum(b), sum(groups)], np.frombuffer(b"".join(pairs), "<u4").astype(np.int64), ";".join(listing)))
        return out


@lru_cache(1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times per document, and the
    listing ``groups`` if asked for.

    ``pairs`` are the distinct linked id pairs, A's id * 65536 + B's, ``times`` their links.
    """

    def run(batches):
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            numbers, sha, listings, pairs, times = [], [], [], [], []
            bodies = batch.column(1).to_pylist()
            for found in (f for at in range(0, len(bodies), 32) for f in aligner.align(bodies[at : at + 32])):
                if found is None:
                    numbers.append([0, 0, 0, 0])
                    sha.append("")
                    listings.append("")
                    pairs.append(None)
                    times.append(None)
                    continue
                counts, each, listing = found
                distinct, often = np.unique(each, return_counts=True)
                numbers.append([*counts, len(each)])
                sha.append(hashlib.sha256(listing.encode()).hexdigest())
                listings.append(listing)
                pairs.append(distinct)
                times.append(often.astype(np.int32))
            arrays = [batch.column(0), *(pa.array([n[k] for n in numbers], pa.int64()) for k in range(4)), pa.array(sha, pa.string())]
            arrays += [pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
            names = ["doc_id", *_NUMBERS, "groups_sha256", "pairs", "times"]
            if with_groups:
                arrays.append(pa.array(listings, pa.string()))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id bigint, {', '.join(f'{n} bigint' for n in _NUMBERS)}, groups_sha256 string, pairs array<bigint>, times array<int>"
    narrow = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return narrow.mapInArrow(run, schema + ", groups string" * with_groups)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (n is its A id's highest)."""
    counts = pin(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.shiftright("pair", _BITS)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _with_head(written: DataFrame, head: tuple[np.ndarray, ...]) -> DataFrame:
    """Sums over the links of known pairs; the other pairs stay as ``pairs`` and ``times``."""
    known, counts, is_best = head

    def run(batches):
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            size = np.diff(pairs.offsets.to_numpy())
            size = np.where(pairs.is_valid().to_numpy(zero_copy_only=False), size, 0)
            pair, often = (c.flatten().to_numpy(zero_copy_only=False) for c in (pairs, times))
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            met = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = [np.zeros(len(size), np.int64) for _ in range(2)]
            np.add.at(sums[0], row[met], often[met] * is_best[at[met]])
            np.add.at(sums[1], row[met], often[met] * counts[at[met]])
            left = np.r_[0, np.cumsum(np.bincount(row[~met], minlength=len(size)))].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~met])) for x in (pair, often)]
            kept = [batch.column(n) for n in ("row", "doc_id", *_NUMBERS, "groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *map(pa.array, sums), *rest], ["row", "doc_id", *_NUMBERS, "groups_sha256", "n_best", "count_sum", "pairs", "times"]
            )

    schema = f"row bigint, doc_id bigint, {', '.join(f'{n} bigint' for n in _NUMBERS)}, groups_sha256 string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<int>"
    return written.mapInArrow(run, schema)


def measured(found: DataFrame, head: int = HEAD) -> DataFrame:
    """``aligned`` documents with n_best and count_sum; one row per row of ``found``."""
    columns = ["doc_id", *_NUMBERS, "groups_sha256", "pairs", "times"]
    written = pin(found.select(F.monotonically_increasing_id().alias("row"), *columns))
    counts = pin(pair_counts(written))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = total // head + 1
    frequent = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    known = tuple(frequent[c].to_numpy() for c in ("pair", "n", "best"))
    summed = _with_head(written, known)
    out = summed.select("row", "doc_id", *_NUMBERS, "groups_sha256", "n_best", "count_sum")
    if len(frequent) < counts.count():
        rest = summed.where(F.size("pairs") > 0).select("row", F.arrays_zip("pairs", "times").alias("z"))
        rest = rest.select("row", F.explode("z").alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("often"))
        met = rest.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"),
            F.sum(F.col("often") * F.col("n")).alias("more_sum"),
        )
        more = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
        out = out.join(met, "row", "left").select(
            "doc_id", *_NUMBERS, "groups_sha256", more("n_best", "more_best"), more("count_sum", "more_sum")
        )
    return out.select("doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256")
