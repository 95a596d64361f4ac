"""License scans over a positional rare-token index.

Notices of known licences are templates. Each template's rarest words, by inverse document
frequency over all given texts, are its anchors; the index holds the anchors with their
positions. A text looks up the anchors it contains; where enough of them stand at the
template's own distances from each other, and a mandatory key phrase stands inside that
span, the template's label is given.

The index is as large as the template list (``MAX_INDEX_WORDS`` bounds it), so it travels inside
the expression; texts are never shuffled and each is judged in its own row. Only the word
frequencies, at most one row per template word and task, are exchanged.

* Null or empty text: no words, no labels, score 0, null first_word and last_word.
* Repeated rows are scanned one by one; columns besides the two named ones are ignored.
* Ties in frequency are broken by the word itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BETWEEN_ALNUM, lower_for_ascii, texts

#: Fixed phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str


#: Opening words of public licence notices.
TEMPLATES = (
    Template("agpl", "licensed under the terms of the gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc0", "dedicated to the public domain under the cc0 1 0 universal dedication", "cc0 1 0"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("mit-notice", "released under the mit license", "the mit license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "any person obtaining a copy"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)

MAX_INDEX_WORDS = 20_000


def _words(text: str) -> list[str]:
    return text.split()


def _check(templates: tuple[Template, ...]) -> None:
    size = sum(len(_words(t.notice)) + len(_words(t.key)) for t in templates)
    if size > MAX_INDEX_WORDS:
        raise ValueError(f"{size} template words; the index inside the plan takes {MAX_INDEX_WORDS}")


def worded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and words."""
    split = F.array_remove(F.split(lower_for_ascii(F.col("text")), BETWEEN_ALNUM), "")
    return texts(docs, doc_id, text).select("doc_id", split.alias("words"))


def document_frequency(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """In how many texts each template word occurs: word, df."""
    _check(templates)
    known = sorted({w for t in templates for w in _words(t.notice)})
    return (
        words.select(F.explode(F.array_intersect("words", F.lit(known))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("df"))
    )


def anchors(df: dict[str, int], template: Template, rare: int) -> list[tuple[str, int]]:
    """The template's ``rare`` rarest words with their positions."""
    words = _words(template.notice)
    order = sorted(range(len(words)), key=lambda i: (df.get(words[i], 0), words[i], i))
    return sorted((words[i], i) for i in order[:rare])


def _all_at(words: Column, parts: list[str], at: Column) -> Column:
    """Whether ``parts`` stand in ``words`` from index ``at``."""
    hit = F.lit(True)
    for k, part in enumerate(parts):
        hit = hit & (F.get(words, at + k) == part)
    return F.coalesce(hit, F.lit(False))


def _no_places() -> Column:
    return F.array().cast("array<int>")


def _places(phrase: str) -> Column:
    """Starts of the phrase in ``words``."""
    words, parts = F.col("words"), _words(phrase)
    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all_at(words, parts, i))
    rarest = F.array_contains(words, parts[0]) & F.array_contains(words, parts[-1])
    return F.when(rarest, found).otherwise(_no_places())


def _index(templates: dict[Template, list[tuple[str, int]]], agree: float) -> Column:
    """The index as one array literal: label, key with its offset, anchors, anchors needed."""
    rows = []
    for t, picked in templates.items():
        notice, key = _words(t.notice), _words(t.key)
        offset = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        rows.append(
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(key).alias("key"),
                F.lit(offset).alias("offset"),
                F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).alias("at")) for w, i in picked)).alias("anchors"),
                F.lit(max(1, math.ceil(agree * len(picked)))).alias("need"),
            )
        )
    return F.array(*rows)


def _agreeing(t: Column) -> Column:
    """The most anchors of template ``t`` that stand at its distances beside its key phrase."""
    words = F.col("words")
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                t["anchors"],
                lambda a: F.transform(
                    F.filter("hits", lambda p: F.get(words, p) == a["w"]), lambda p: p - a["at"]
                ),
            )
        )
    )

    def votes(start: Column) -> Column:
        met = F.filter(t["anchors"], lambda a: F.coalesce(F.get(words, start + a["at"]) == a["w"], F.lit(False)))
        spoken = lambda w, k: F.coalesce(F.get(words, start + t["offset"] + k) == w, F.lit(False))
        whole = F.size(F.filter(t["key"], spoken)) == F.size(t["key"])
        return F.when(whole, F.size(met)).otherwise(0)

    return F.coalesce(F.array_max(F.transform(starts, votes)), F.lit(0))


def scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    rare: int = 4,
    agree: float = 0.75,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``rare`` anchors are taken per template; a share ``agree`` of them must stand at the
    template's distances. ``score`` is the largest such share among the labels given, and
    0.5 where only a base phrase is found.
    """
    words = worded(docs, doc_id, text)
    known = {r["word"]: r["df"] for r in document_frequency(words, templates).collect()}
    index = {t: anchors(known, t, rare) for t in templates}
    vocabulary = F.lit(sorted({w for picked in index.values() for w, _ in picked}))
    looked_up = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: F.array_contains(vocabulary, F.get("words", i)),
    )

    judged = F.transform(
        _index(index, agree),
        lambda t: F.struct(
            t["label"].alias("label"),
            t["need"].alias("need"),
            F.size(t["anchors"]).alias("of"),
            _agreeing(t).alias("met"),
        ),
    )
    found = F.transform(
        F.filter(judged, lambda x: x["met"] >= x["need"]),
        lambda x: F.struct(x["label"].alias("label"), (x["met"] / x["of"]).alias("share")),
    )
    struct = "array<struct<label:string,share:double>>"
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    first_words = sorted({_words(p)[0] for p, _ in BASE})
    return (
        words.withColumn(
            "hits", F.when(F.arrays_overlap("words", vocabulary), looked_up).otherwise(_no_places())
        )
        .withColumn(
            "by_phrase",
            F.when(
                F.arrays_overlap("words", F.lit(first_words)), F.array(*(_places(p) for p, _ in BASE))
            ).otherwise(F.array(*(_no_places() for _ in BASE))),
        )
        .withColumn("starts", F.flatten("by_phrase"))
        .withColumn(
            "base",
            F.array_compact(
                F.array(*(F.when(F.size(F.get("by_phrase", F.lit(k))) > 0, x) for k, (_, x) in enumerate(BASE)))
            ),
        )
        .withColumn(
            "found",
            F.when(F.size("hits") > 0, found).otherwise(F.array().cast(struct)),
        )
        .select(
            "doc_id",
            F.size("words").cast("bigint").alias("n_words"),
            F.size("starts").cast("bigint").alias("n_base"),
            F.array_min("starts").cast("bigint").alias("first_word"),
            F.array_max("starts").cast("bigint").alias("last_word"),
            joined(F.col("base")).alias("base_labels"),
            joined(F.concat("base", F.transform("found", lambda x: x["label"]))).alias("labels"),
            F.greatest(
                F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)),
                F.when(F.size("base") > 0, 0.5).otherwise(0.0),
            ).alias("score"),
        )
    )
