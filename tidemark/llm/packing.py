"""Packing of token sequences: best-fit decreasing over a segment tree.

Texts become ids of a public tokenizer, each followed by an end id. A text longer than the
window is first cut into full windows and a rest. Pieces are dealt to buckets of about
``bucket`` pieces; each bucket is packed by best-fit decreasing: pieces in falling length go
to the open window with the least sufficient capacity, which a segment tree indexed by
remaining capacity finds in logarithmic time. A bucket leaves at most a few windows half
empty, so the padding does not depend on how many buckets there are.

Buckets are dealt by row number of the written pieces, not by a key, so a repeated document
or a hot source cannot fill one of them.

* Null or empty text: one piece of the end id alone. Repeated rows are packed one by one.
* Ties in length are taken in order of doc_id and start. Very long texts: many full windows.
* Columns besides the two named ones are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts
from tidemark.session import pin

WINDOW, END = 2048, 1
#: Chunks of text whose ids one generation of a task's memory holds.
REMEMBERED = 400_000
#: White space besides spaces and line feeds, and the sign used for cutting.
_OTHER = re.compile(r"[^\S\n ]|\0")
_WORD = re.compile(r" ?[^\s\0]+\Z")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by ``tokenizers``, as little-endian unsigned 32-bit numbers.

    This byte-level vocabulary always starts a new unit at a space between two other than
    white-space characters, around a line feed between such, and before a full stop or comma
    that ends a chunk after a letter or digit. A text is cut there, and the ids of each chunk
    are remembered in two generations of bounded size, so frequent chunks stay known.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)  # byte-level: one character a byte
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.marks = {m: array("I", self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in ".,"}

    def chunks(self, text: str) -> list[str]:
        # Words parted by single spaces and line feeds only.
        if "\0" not in text and text.split() == text.replace("\n", " ").split(" "):
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        parts = text.split(" ")
        out = parts[:1]
        for part in parts[1:]:
            last = out[-1]
            if part and last and not part[0].isspace() and not last[-1].isspace() and last != " ":
                out.append(" " + part)
            else:
                out[-1] = f"{last} {part}"
        return out

    def each(self, chunks: list[str]) -> list[bytes]:
        """Ids of every chunk, from one encoding of all that are words; the others one by one.

        Words that a space or line feed parts do not touch each other, so the ids of the line
        of words are those of the words, told apart by the ids' lengths in bytes.
        """
        words = list(filter(_WORD.match, chunks))
        lead = [c[0] == " " for c in words]
        line = "".join(words) if all(lead) else "".join([c if s else "\n" + c for c, s in zip(words, lead)])
        ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int64) if line else np.empty(0, np.int64)
        ends = np.cumsum([len(c.encode()) + (not s) for c, s in zip(words, lead)])
        till = np.cumsum(self.size[ids])
        stop = np.searchsorted(till, ends)
        if len(words) == 0 or len(ids) == 0 or (stop >= len(till)).any() or (till[stop] != ends).any():
            found = {}
        else:
            coded, stop = ids.astype("<u4").tobytes(), (4 * (stop + 1)).tolist()
            start = [0, *stop[:-1]]
            found = {c: coded[a + (0 if s else 4) : b] for c, s, a, b in zip(words, lead, start, stop)}
        rest = [c for c in chunks if c not in found]
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            found[c] = array("I", e.ids).tobytes()
        return [found[c] for c in chunks]

    def _learn(self, new: set[str]) -> None:
        known, older, plain, marked = self.known, self.older, [], []
        for chunk in new:
            ids = older.get(chunk)
            if ids is not None:
                known[chunk] = ids
            elif chunk[-1] in ".," and chunk[-2:-1].isalnum():
                marked.append(chunk)
                if chunk[:-1] not in known and chunk[:-1] not in older:
                    plain.append(chunk[:-1])
            else:
                plain.append(chunk)
        known.update(zip(plain, self.each(plain)))
        for chunk in marked:
            core = chunk[:-1]
            known[chunk] = (known[core] if core in known else older[core]) + self.marks[chunk[-1]]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = self.chunks(text)
        new = set(chunks).difference(self.known)
        if new:
            if len(self.known) > REMEMBERED:
                self.older, self.known = self.known, {"": b""}
                new = set(chunks) - {""}
            self._learn(new)
        return b"".join(map(self.known.__getitem__, chunks))


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(
    docs: DataFrame,
    path: str,
    window: int = WINDOW,
    with_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and ``ids`` if asked for, per piece."""

    def cut(batches):
        encoder, end = _encoder(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            doc, start, length, crc, tokens, ids = [], [], [], [], [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = encoder.encode(body) + end
                for at in range(0, len(coded), 4 * window):
                    piece = coded[at : at + 4 * window]
                    doc.append(key)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    tokens.append(len(coded) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            arrays = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, tokens)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    narrow = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return narrow.mapInArrow(cut, schema + ", ids array<int>" * with_ids)


class Capacities:
    """Segment tree over remaining capacities 0..size: which have open windows."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """Takes out a window of the least capacity that is at least ``need``; its capacity."""
        at = self.leaves + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; ``lengths`` fall and are at most ``size``."""
    tree, numbers, offsets, n = Capacities(size), [], [], 0
    for length in lengths:
        capacity = tree.tightest(length)
        if capacity is None:
            number, capacity, n = n, size, n + 1
        else:
            number = tree.take(capacity)
        numbers.append(number)
        offsets.append(size - capacity)
        if capacity > length:
            tree.add(capacity - length, number)
    return numbers, offsets


def pack(cut: DataFrame, window: int = WINDOW, bucket: int = 4096) -> DataFrame:
    """``cut`` with sequence_id and offset; ``cut`` has doc_id, start and length of pieces."""
    written = pin(cut)
    n_buckets = max(1, -(-written.count() // bucket))
    schema = written.schema.add("sequence_id", "long").add("offset", "long")

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        base = int(rows["_bucket"].iloc[0]) << 32
        rows = rows.drop(columns="_bucket").sort_values(
            ["length", "doc_id", "start"], ascending=[False, True, True], kind="stable"
        )
        numbers, offsets = best_fit_decreasing(rows["length"].tolist(), window)
        return rows.assign(sequence_id=[base + x for x in numbers], offset=offsets)

    row = F.monotonically_increasing_id()
    dealt = written.withColumn("_bucket", F.pmod(F.xxhash64(row), F.lit(n_buckets)))
    return dealt.groupBy("_bucket").applyInPandas(fill, schema)
