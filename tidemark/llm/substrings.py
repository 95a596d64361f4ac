"""Substring deduplication: an FM-index per shard, queried by streamed documents.

A word is removed if a window of ``window`` consecutive words over it also starts in a
document with a smaller id.

1. Every window has an anchor, its ``gram``-word part with the least hash; equal windows have
   equal anchors. A batch sends each anchor once, with the least document that has it; what
   repeats inside the batch is known to repeat there and then. So no anchor, however common,
   comes more than once per batch. Whole documents are looked up in the same way: of exact
   copies only the one with the least id goes on, the others are removed whole.
2. Windows with an anchor that several documents have form short segments. Segments are dealt
   to shards by anchor; anchors of very many documents, whose number is bounded, deal each
   window by its own hash instead. Again a batch sends equal segments once.
3. A shard builds a compressed FM-index of its segments (suffix array by doubling to the
   window's length, Burrows-Wheeler transform in a wavelet matrix of packed bits with counted
   blocks) and searches the segments backward, all at once, a word per step, from the intervals
   of the last eight words on, which sorting has told; a match that is down to its own place stops. Matches of full length whose suffix interval holds a smaller
   document are reported as intervals of words.
4. The intervals return to the documents by id; the words left are joined and hashed.

* Null or empty text: no words. Fewer words than a window: nothing is removed.
* Rows with a null id remove nothing and lose nothing. Rows that repeat an id are the same
  document; should their texts differ, an interval found in one counts for all of them.
* Very long texts are cut in nothing but numpy arrays of their words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import raw, texts
from tidemark.llm.links import mixed, word_hashes
from tidemark.session import pin

WINDOW, GRAM = 13, 6
#: Texts whose words are hashed together.
TOGETHER = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _rolled(each: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive word hashes."""
    out = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * _GOLD + each[k : len(each) - size + 1 + k])
    return out


def anchors(each: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window: the place of its anchor, and of every place: its hash."""
    grams = _rolled(each, gram)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    return np.arange(len(views)) + views.argmin(axis=1), grams


def _firsts(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document; in it, where a key begins, and where a document of a key does."""
    order = np.lexsort((docs, keys))
    new = np.r_[True, keys[order][1:] != keys[order][:-1]][: len(order)]
    each = new | np.r_[True, docs[order][1:] != docs[order][:-1]][: len(order)]
    return order, new, each


def occurrences(docs: DataFrame, window: int, gram: int, batch_anchors: int = 1_000_000) -> DataFrame:
    """key, check, doc_id, place, n, known.

    ``place`` is an anchor's word index in the document, -1 for the whole document. Rows that
    are ``known`` have a key of their own; the others are the least document of their batch,
    ``n`` being the number of documents that it stands for.
    """

    def flush(keys, checks, owners, places):
        key, check, doc, place = map(np.concatenate, (keys, checks, owners, places))
        whole = place < 0
        copies = doc[whole][doc[whole] != _least(key[whole], doc[whole])]
        rows = whole | ~np.isin(doc, copies)
        key, check, doc, place = key[rows], check[rows], doc[rows], place[rows]
        order, new, each = _firsts(key, doc)
        key, check, doc, place = key[order], check[order], doc[order], place[order]
        group = np.cumsum(new) - 1
        n = np.bincount(group[each], minlength=group[-1] + 1)[group]
        known = each & (n > 1) & ~((place < 0) & new)
        own = mixed(key ^ mixed(doc.view(np.uint64) + _GOLD))
        for rows, keyed, is_known in ((new, key, False), (known, own, True)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keyed[rows].view(np.int64)),
                    pa.array(check[rows].view(np.int64)),
                    pa.array(doc[rows]),
                    pa.array(place[rows].astype(np.int32)),
                    pa.array(n[rows].astype(np.int32)),
                    pa.array(np.full(rows.sum(), is_known)),
                ],
                ["key", "check", "doc_id", "place", "n", "known"],
            )

    def run(batches):
        held, parts = 0, ([], [], [], [])
        for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
            split = [body.split() for body in raw(batch.column(1))]
            for doc, words, each in zip(batch.column(0).to_pylist(), split, word_hashes(split)):
                if doc is None or len(words) < window:
                    continue
                whole = xxhash.xxh3_128_intdigest(b" ".join(words))
                at, grams = anchors(each, window, gram)
                at = np.unique(at)
                value, first = np.unique(grams[at], return_index=True)
                check = np.zeros(len(value) + 1, np.uint64)
                check[0] = whole >> 64
                rows = (
                    np.r_[np.uint64(whole & (2**64 - 1)), value],
                    check,
                    np.full(len(check), doc),
                    np.r_[-1, at[first]],
                )
                for part, x in zip(parts, rows):
                    part.append(x)
                held += len(check)
                if held >= batch_anchors:
                    yield from flush(*parts)
                    held, parts = 0, ([], [], [], [])
        if held:
            yield from flush(*parts)

    schema = "key bigint, check bigint, doc_id bigint, place int, n int, known boolean"
    return docs.mapInArrow(run, schema)


class FMIndex:
    """Backward search for patterns of up to ``depth`` symbols in an array of small integers."""

    def __init__(self, text: np.ndarray, depth: int):
        rank, h = text.astype(np.int64), 1
        while True:
            after = np.zeros(len(text), np.int64)
            after[:-h] = rank[h:] + 1
            key = rank * (int(rank.max()) + 2) + after
            if 2 * h >= depth:
                break
            rank = np.unique(key, return_inverse=True)[1]
            h *= 2
        self.text = text
        self.order = np.argsort(key)
        # the suffix interval of every ``known`` symbols that occur, by their rank
        self.known, self.rank = h, rank
        self.grams = np.r_[0, np.cumsum(np.bincount(rank))]
        self.counts = np.r_[0, np.cumsum(np.bincount(text))]
        current, self.levels = text[self.order - 1], []
        for level in reversed(range(max(1, int(text.max()).bit_length()))):
            bits = (current >> level) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed = np.r_[packed, np.zeros(16 - len(packed) % 8, np.uint8)].view(np.uint64)
            blocks = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)][:-1]
            self.levels.append((level, packed, blocks, len(text) - int(bits.sum())))
            current = np.r_[current[bits == 0], current[bits == 1]]
        symbols = np.arange(len(self.counts) - 1)
        self.bottom = self._down(symbols, np.zeros(len(symbols), np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` leads through the wavelet matrix along ``symbol``."""
        for level, packed, blocks, zeros in self.levels:
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = blocks[word] + np.bitwise_count(packed[word] & mask)
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def shared(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text's own patterns at ``starts``: those with more than one match, as indexes
        into ``starts`` with the lower and upper end of their suffix interval.

        The search begins with the interval of the last ``known`` symbols, from the table."""
        rows, last = np.arange(len(starts)), size - self.known
        if last < 0:
            last, low, high = size, np.zeros(len(starts), np.int64), np.full(len(starts), len(self.text))
        else:
            gram = self.rank[starts + last]
            low, high = self.grams[gram], self.grams[gram + 1]
        alive = high - low > 1
        rows, low, high = rows[alive], low[alive], high[alive]
        for k in reversed(range(last)):
            symbol = self.text[starts[rows] + k]
            base = self.counts[symbol] - self.bottom[symbol]
            low, high = base + self._down(symbol, low), base + self._down(symbol, high)
            alive = high - low > 1
            rows, low, high = rows[alive], low[alive], high[alive]
        return rows, low, high


def matched(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Intervals of words in segments (doc_id, start, text) that a smaller document has too."""
    words = [t.split(b" ") for t in rows["text"]]
    codes: dict[bytes, int] = {}
    flat: list[int] = []
    for own in words:
        flat += [codes.setdefault(w, len(codes) + 1) for w in own]
        flat.append(0)
    text = np.array(flat, np.int64)
    lengths = np.array([len(w) for w in words])
    begin = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    segment = np.repeat(np.arange(len(words)), lengths + 1)
    inside = np.arange(len(text)) - begin[segment]
    starts = np.flatnonzero(inside <= lengths[segment] - window)
    index = FMIndex(text, window)
    found, low, high = index.shared(starts, window)
    owner = rows["doc_id"].to_numpy()[segment]
    if len(found):
        by_suffix = np.r_[owner[index.order], np.iinfo(np.int64).max]
        distinct, first, back = np.unique(low, return_index=True, return_inverse=True)
        ends = np.stack([distinct, high[first]], axis=1).ravel()
        least = np.minimum.reduceat(by_suffix, ends)[::2][back]
        at = starts[found[least < owner[starts[found]]]]
    else:
        at = np.empty(0, np.int64)
    at = np.sort(at)
    opens = np.r_[True, np.diff(at) > 1][: len(at)]
    closes = np.r_[np.diff(at) > 1, True][: len(at)]
    offset = rows["start"].to_numpy()[segment] + inside
    return pd.DataFrame(
        {"doc_id": owner[at[opens]], "start": offset[at[opens]], "stop": offset[at[closes]] + window}
    )


def segments(docs: DataFrame, window: int, gram: int, shards: int, common: set[int]) -> DataFrame:
    """shard, doc_id, start, stop, text of stretches whose anchors several documents have.

    ``docs`` has doc_id, text and the places of such anchors. Of equal stretches in a batch the
    least document's is sent; the others' are known to be repeats and have no text.
    """
    hot = docs.sparkSession.sparkContext.broadcast(np.array(sorted(common), np.int64).view(np.uint64))

    def stretches(words, each, places):
        at, grams = anchors(each, window, gram)
        here = np.isin(grams[at], grams[places])
        keys = grams[at]
        if len(hot.value):
            very = np.isin(keys, hot.value)
            keys = np.where(very, _rolled(each, window), keys)
        rows = np.flatnonzero(here)
        new = np.r_[True, (np.diff(rows) > 1) | (keys[rows][1:] != keys[rows][:-1])][: len(rows)]
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(rows) - 1][: new.sum()]
        for a, b in zip(rows[new].tolist(), rows[last].tolist()):
            yield int(keys[a]), a, b + window, b" ".join(words[a : b + window])

    def run(batches):
        for batch in batches:
            found = []
            for part in (batch.slice(at, TOGETHER) for at in range(0, batch.num_rows, TOGETHER)):
                split = [body.split() for body in raw(part.column(1))]
                for doc, places, words, each in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), split, word_hashes(split)):
                    found += [(doc, *s) for s in stretches(words, each, places)]
            least: dict[bytes, int] = {}
            for doc, _, _, _, text in found:
                least[text] = min(doc, least.get(text, doc))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(k if d == least[t] else d) % shards for d, k, _, _, t in found], pa.int64()),
                    pa.array([d for d, *_ in found], pa.int64()),
                    pa.array([a for _, _, a, _, _ in found], pa.int64()),
                    pa.array([b for _, _, _, b, _ in found], pa.int64()),
                    pa.array([t if d == least[t] else None for d, _, _, _, t in found], pa.binary()),
                ],
                ["shard", "doc_id", "start", "stop", "text"],
            )

    return docs.mapInArrow(run, "shard bigint, doc_id bigint, start bigint, stop bigint, text binary")


def _least(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The least document of each row's key."""
    _, back = np.unique(keys, return_inverse=True)
    out = np.full(back.max() + 1 if len(back) else 0, np.iinfo(np.int64).max)
    np.minimum.at(out, back, docs)
    return out[back]


def remove(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    shard_rows: int = 50_000,
    common: int = 100_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the merged ``intervals`` removed.

    ``common``: documents with one anchor from which on its windows are dealt one by one; at
    least a thousandth of all documents, so that the list of such anchors is bounded.
    """
    bare = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    named = bare.where("doc_id is not null")
    same = Window.partitionBy("key", "check")
    seen = (
        occurrences(named, window, gram)
        .withColumn("low", F.min("doc_id").over(same))
        .withColumn("high", F.max("doc_id").over(same))
        .withColumn("total", F.sum("n").over(same))
    )
    repeated = pin(
        seen.where("known or (low < high and (place >= 0 or doc_id > low))").select(
            "key", "doc_id", "place", F.when(F.col("place") < 0, 0).otherwise(F.col("total")).alias("total")
        )
    )
    n_rows, n_docs = repeated.count(), bare.count()
    over = repeated.where(F.col("total") >= max(common, n_docs // 1000))
    hot = {r["key"] for r in over.select("key").distinct().collect()}
    places = repeated.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    placed = named.join(places, "doc_id", "left")
    inner = named.join(places, "doc_id").where(~F.array_contains("places", -1))
    dealt = segments(inner, window, gram, max(64, n_rows // shard_rows), hot)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows["text"].isna()
        parts = [rows.loc[known, ["doc_id", "start", "stop"]]]
        if not known.all():
            parts.append(matched(rows[~known].reset_index(drop=True), window))
        return pd.concat(parts)

    found = dealt.groupBy("shard").applyInPandas(search, "doc_id bigint, start bigint, stop bigint")
    intervals = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    return _cut(placed.join(intervals, "doc_id", "left"), window).unionByName(
        _cut(bare.where("doc_id is null").withColumns({"places": F.lit(None).cast("array<int>"), "found": F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")}), window)
    )


_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Documents without the intervals found; all of it where place -1 tells of a copy."""

    def run(batches):
        for batch in batches:
            n_words, n_removed, digests, intervals = [], [], [], []
            for body, places, found in zip(
                raw(batch.column("text")), batch.column("places").to_pylist(), batch.column("found").to_pylist()
            ):
                words = body.split()
                spans = [(s["start"], s["stop"]) for s in found or ()]
                if -1 in (places or ()) and len(words) >= window:
                    spans = [(0, len(words))]
                merged: list[dict] = []
                for start, stop in sorted(spans):
                    stop = min(stop, len(words))
                    if merged and start <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(stop, merged[-1]["stop"])
                    elif start < stop:
                        merged.append({"start": start, "stop": stop})
                kept, done = [], 0
                for m in merged:
                    kept += words[done : m["start"]]
                    done = m["stop"]
                kept += words[done:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                intervals.append(merged)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(intervals, _INTERVALS),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals"],
            )

    schema = (
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
        "intervals array<struct<start:bigint,stop:bigint>>"
    )
    return docs.mapInArrow(run, schema)
