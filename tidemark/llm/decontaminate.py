"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one
window), and a window into shingles of ``shingle`` words. A text contains a window only if
it contains all its shingles, so the necessary prefix of each window, its shingles being
ordered by how many texts hold them, is its rarest shingle. Texts are joined with the prefix
shingles alone; the shingle's place in the window gives the only possible start (positional
bound), the text's ends give the length bound, and the window's words are compared exactly.

The benchmark is taken in blocks of at most ``block`` (window, item) pairs, so a task and the
driver hold a bounded index whatever its size; a larger benchmark means more passes. Texts
are never shuffled or collected; only shingle counts of one block are.

* Null or empty text: no words, no hits. An item without words has no windows.
* An item without id marks words but is not listed. Repeated items count once per id.
* Repeated rows and equal ids of documents are marked row by row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM_TABLE, named, raw, texts
from tidemark.session import pin

SCHEMA = (
    "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _grams(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    return zip(*(words[k:] for k in range(size)))


def windows(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text"):
    """Distinct (words, item) pairs, the words joined by one space."""

    def cut(batches):
        for batch in batches:
            words, items = [], []
            for item, body in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                own = body.translate(ALNUM_TABLE).split()
                size = min(window, len(own))
                found = {b" ".join(g).decode() for g in _grams(own, size)} if size else ()
                words += found
                items += [item] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(items, pa.string())], ["words", "item"]
            )

    items = benchmark.select(named(item_id).cast("string").alias("item"), named(text).alias("text"))
    return items.mapInArrow(cut, "words string, item string").distinct()


def _counts(docs: DataFrame, shingles: set[tuple[bytes, ...]]) -> dict[bytes, int]:
    """In how many texts each of the given shingles occurs."""
    known = docs.sparkSession.sparkContext.broadcast(shingles)

    def count(batches):
        sizes, seen = {len(s) for s in known.value}, Counter()
        for batch in batches:
            for body in raw(batch.column(0)):
                words = body.translate(ALNUM_TABLE).split()
                for size in sizes:
                    seen.update(known.value.intersection(_grams(words, size)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([b" ".join(s) for s in seen], pa.binary()), pa.array(seen.values(), pa.int64())],
            ["shingle", "n"],
        )

    per_task = docs.select("text").mapInArrow(count, "shingle binary, n bigint")
    return {bytes(r[0]): r[1] for r in per_task.groupBy("shingle").agg(F.sum("n")).collect()}


def _index(pairs: list, counts: dict[bytes, int], shingle: int) -> dict:
    """Rarest shingle -> [(its place, the window's words, the window's items)]."""
    items: dict[str, list[str]] = defaultdict(list)
    for words, item in pairs:
        items[words].append(item)
    index: dict = defaultdict(list)
    for window, own in items.items():
        words = window.encode().split(b" ")
        grams = list(_grams(words, min(shingle, len(words))))
        place = min(range(len(grams)), key=lambda i: (counts.get(b" ".join(grams[i]), 0), grams[i], i))
        index[grams[place]].append((place, words, [x for x in own if x is not None]))
    return dict(index)


def _search(words: list[bytes], index: dict, sizes: list[int]) -> tuple[list, set[str]]:
    spans, items = [], set()
    for size in sizes:
        for at, gram in enumerate(_grams(words, size)):
            if gram in index:
                for place, window, own in index[gram]:
                    start = at - place
                    if 0 <= start <= len(words) - len(window) and words[start : start + len(window)] == window:
                        spans.append((start, start + len(window)))
                        items.update(own)
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _marked(docs: DataFrame, index: dict, last: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = ["doc_id", "n_words", "spans", "items"] + ["text"] * (not last)

    def mark(batches):
        prefix = shared.value
        sizes = sorted({len(s) for s in prefix})
        for batch in batches:
            n_words, all_spans, all_items = [], [], []
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            for body, (spans, items) in zip(raw(batch.column("text")), before):
                words = body.translate(ALNUM_TABLE).split()
                found, own = _search(words, prefix, sizes)
                n_words.append(len(words))
                if found:
                    spans = [(s["start"], s["end"]) for s in spans] + found
                    spans = [{"start": s, "end": e} for s, e in _merged(spans)]
                all_spans.append(spans)
                all_items.append(sorted(own.union(items)))
            arrays = [
                batch.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(all_spans, _SPANS),
                pa.array(all_items, pa.list_(pa.string())),
            ] + [batch.column("text")] * (not last)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(mark, SCHEMA + ", text string" * (not last))


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block: int):
    """The prefix index of each block of the benchmark; ``docs`` has only a column text."""
    pairs = pin(windows(benchmark, window))
    n_blocks = max(1, -(-pairs.count() // block))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(n_blocks)))
    for k in range(n_blocks):
        own = [(r["words"], r["item"]) for r in dealt.where(F.col("block") == k).collect()]
        shingles = set()
        for words, _ in own:
            split = words.encode().split(b" ")
            shingles.update(_grams(split, min(shingle, len(split))))
        yield _index(own, _counts(docs, shingles) if own else {}, shingle), k == n_blocks - 1


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shingle: int = 3,
    block: int = 100_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Each document's doc_id, ``n_words``, word ``spans`` hit (merged, end exclusive), ``items``."""
    bare = texts(docs, doc_id, text)
    out = bare.selectExpr(
        "cast(doc_id as bigint) doc_id",
        "text",
        "cast(array() as array<struct<start:bigint,end:bigint>>) spans",
        "cast(array() as array<string>) items",
    )
    for index, last in _blocks(bare.select("text"), benchmark, window, shingle, block):
        out = _marked(out, index, last)
        out = out if last else pin(out)
    return out


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, block: int = 100_000
) -> DataFrame:
    """The documents, with all their columns, whose ``text`` no window of the benchmark hits."""
    at, out = docs.columns.index("text"), docs

    def without(index: dict):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches):
            prefix = shared.value
            sizes = sorted({len(s) for s in prefix})
            for batch in batches:
                split = (body.translate(ALNUM_TABLE).split() for body in raw(batch.column(at)))
                yield batch.filter(pa.array([not _search(words, prefix, sizes)[0] for words in split], pa.bool_()))

        return keep

    bare = texts(docs, docs.columns[0]).select("text")
    for index, last in _blocks(bare, benchmark, window, shingle, block):
        out = out.mapInArrow(without(index), docs.schema)
        out = out if last else pin(out)
    return out


def digest(marked: DataFrame) -> DataFrame:
    """The counts and the items' hash that stand for a marked document."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
