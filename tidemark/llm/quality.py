"""Quality rules, line first: failing lines are removed, then documents that lost too much go.

Built-in column functions only; every document is judged inside its own row, so nothing is
shuffled and no group of documents can become hot.

* Null or empty text: no words, no lines, ``base_failed``, not kept.
* Repeated rows and equal ``doc_id``s are judged one by one; other columns are ignored.
* Very long texts cost their length times its logarithm (one sort of their windows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bind, space_words, texts

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»"
WHITE_SPACE = " \t\n\x0b\f\r"
TERMINAL = (".", "!", "?", "…", '"', "”", "»", ":", ";", ")", "'")
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "cookie settings", "enable javascript",
    "lorem ipsum", "privacy policy", "read more", "sign in", "subscribe to", "terms of use",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeated: float = 0.5
    max_symbols_per_word: float = 0.3
    max_upper_share: float = 0.4
    max_separators: int = 3
    short_line_words: int = 4
    boilerplate_words: int = 15
    max_lost: float = 0.5


def _only(text: Column, chars: str) -> Column:
    """The characters of ``text`` that belong to a regular expression's set."""
    return F.regexp_replace(text, f"[^{chars}]+", "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``words``.

    Window hashes tell most texts to have no such window; the others sort their windows and
    compare the words themselves.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def same(x: Column, y: Column) -> Column:
        equal = x["hash"] == y["hash"]
        for k in range(3):
            equal = equal & (F.get(words, x["at"] + k) == F.get(words, y["at"] + k))
        return F.coalesce(equal, F.lit(False))

    window = lambda i: F.struct(hashed(i).alias("hash"), i.alias("at"))
    twice = lambda s: F.sort_array(
        F.transform(
            F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))),
            lambda x: x["at"],
        )
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(x - F.get(p, j - 1), F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    exact = bind(bind(F.sort_array(F.transform(starts, window)), twice), covered)
    maybe = bind(F.transform(starts, hashed), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(words) >= 3) & maybe, exact).otherwise(0).cast("bigint")


def line_fails(line: Column, rules: Rules = Rules()) -> Column:
    """Whether one line is navigation, boilerplate, shouting, symbols or a bare label."""
    n_words = F.size(F.split(line, " "))
    last = F.right(F.btrim(line, F.lit(WHITE_SPACE)), F.lit(1))
    marks = lambda odd: (
        (F.length(_only(odd, SYMBOLS)) > rules.max_symbols_per_word * n_words)
        | (F.length(_only(odd, SEPARATORS)) >= rules.max_separators)
        | ((n_words >= 3) & (F.length(_only(odd, "A-Z")) > rules.max_upper_share * F.length(line)))
    )
    return (
        ((n_words < rules.short_line_words) & ~last.isin(*TERMINAL))
        | ((n_words <= rules.boilerplate_words) & F.lower(line).rlike("|".join(BOILERPLATE)))
        | bind(_only(line, f"A-Z{SYMBOLS}{SEPARATORS}"), marks)
    )


def judge(
    docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, the counts, ``clean_text`` (failing lines removed), base_failed, kept."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE_SPACE)) != "")
    counted = (
        texts(docs, doc_id, text)
        .withColumn("words", space_words(F.col("text")))
        .withColumn("lines", lines)
        .withColumn("good", F.filter("lines", lambda x: ~line_fails(x, rules)))
        .select(
            "doc_id",
            F.size("words").cast("bigint").alias("n_words"),
            F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
            F.length(_only(F.col("text"), SYMBOLS)).cast("bigint").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
            repeated_words(F.col("words")).alias("n_repeat_words"),
            F.length(F.array_join("lines", "")).alias("line_chars"),
            F.length(F.array_join("good", "")).alias("left_chars"),
            F.array_join("good", "\n").alias("clean_text"),
        )
    )
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") > rules.max_repeated * F.col("n_words")
    )
    enough = F.col("left_chars") >= (1 - rules.max_lost) * F.col("line_chars")
    judged = counted.withColumn("base_failed", failed).withColumn("kept", ~failed & enough)
    return judged.drop("line_chars", "left_chars")
