"""Scripts to statements.

A script is cut at every ``;`` that lies outside quotes, comments and dollar-quoted
bodies.  Two regular expressions do that JVM-side: one tells whether every piece that
can hide a ``;`` is closed, the other extracts the runs between the cuts.  A script that
is not closed is looked at piece by piece for the reason.

Block comments that nest are no regular language, but those up to a known depth are one.
One aggregate over the comment edges of such a script gives a depth that it cannot exceed,
and the same expressions are built for that depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import WHITE_SPACE

# Why a script cannot be split.
OPEN_COMMENT = "unterminated block comment"
OPEN_STRING = "unterminated string literal"
OPEN_IDENTIFIER = "unterminated quoted identifier"
OPEN_DOLLAR = "unterminated dollar-quoted block ($%s$)"
NOT_TEXT = "stream did not contain valid UTF-8"
CANNOT_SPLIT = "cannot split migration into statements: "
NO_STATEMENTS = "migration file contains no SQL statements"

#: Nesting up to which comments are followed; each level costs the matcher some of its stack.
DEEPEST = 300
TOO_DEEP = f"block comments nest more than {DEEPEST} deep"

# Possessive quantifiers keep the matcher iterative, whatever the length of the text.
_TAG = r"(?:[A-Za-z_][A-Za-z0-9_]*+)?+"
_DOLLAR = rf"\$({_TAG})\$[\s\S]*?\$\1\$"
_IN_COMMENT = r"[^*/]++|\*(?!/)|/(?!\*)"
_FLAT_COMMENT = rf"/\*(?:{_IN_COMMENT})*+\*/"

# What a closed script consists of, apart from the cuts and comments.  A quote knows by
# looking back whether it opens an escape string, so that plain text is matched in long runs.
_AFTER_E = r"(?<![A-Za-z0-9_])[eE]"
_CLOSED = (
    r"""(?:[^;'"$/\-]++|-(?!-)|/(?!\*))++|--[^\n]*+|"[^"]*+\""""
    rf"|(?<!{_AFTER_E})'[^']*+'|(?<={_AFTER_E})'(?:[^'\\]++|\\[\s\S]|'')*+'"
    rf"|{_DOLLAR}|\$(?!{_TAG}\$)"
)

# Any script, piece by piece: each hiding piece closed first, then open to the end.
_ESCAPED = r"(?<![A-Za-z0-9_])[eE]'(?:[^'\\]++|\\[\s\S]|'')*+'"
_PLAIN = r"""(?:[^;'"$/\-eE]++|[eE](?!')|-(?!-)|/(?!\*))++"""
_QUOTES = (
    _ESCAPED
    + r"|(?<![A-Za-z0-9_])[eE]'[\s\S]*+"
    + r"|'[^']*+'|'[\s\S]*+"
    + r'|"[^"]*+"|"[\s\S]*+'
    + rf"|{_DOLLAR}|\${_TAG}\$[\s\S]*+"
)
# Edges of comments; where two overlap, those that lead deeper.
_EDGES = r"/(?=\*)|(?<!/)\*(?=/)"


def _around(comment: str | Column) -> dict[str, Column]:
    """The expressions for scripts whose closed comments match ``comment``."""

    def around(before: str, after: str) -> Column:
        if isinstance(comment, str):
            return F.lit(before + comment + after)  # a constant, which Spark compiles once
        return F.concat(F.lit(before), comment, F.lit(after))

    return {
        "whole": around(rf"^(?:{_CLOSED}|", r"|;)*+\z"),
        "run": around(rf"(?:{_CLOSED}|", ")++"),
        "pieces": around(rf"{_PLAIN}|--[^\n]*+|", rf"|/\*[\s\S]*+|{_QUOTES}|[\s\S]"),
        "leading": around(r"^(?:[ \t\n\f\r]++|--[^\n]*+|", ")*+"),
        "comment": around("^", r"\z"),
    }


def _nesting(text: Column) -> Column:
    """How deep the comments of a script can nest at most."""
    edges = F.regexp_extract_all(text, F.lit(_EDGES), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, edge: Column) -> Column:
        now = F.greatest(s["now"] + F.when(edge == "/", 1).otherwise(-1), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(edges, start, step)["most"]


def _open_piece(last: Column, comment: Column) -> Column:
    """Which error the last piece of a script means, if it was never closed."""
    def unclosed(mark: str) -> Column:
        return F.startswith(last, F.lit(mark)) & (
            (F.char_length(last) < 2) | ~F.endswith(last, F.lit(mark))
        )

    return (
        F.when(F.startswith(last, F.lit("/*")) & ~F.rlike(last, comment), OPEN_COMMENT)
        .when(unclosed("'"), OPEN_STRING)
        .when(last.rlike("^[eE]'") & ~last.rlike(rf"^{_ESCAPED}\z"), OPEN_STRING)
        .when(unclosed('"'), OPEN_IDENTIFIER)
        .when(
            last.rlike(rf"^\${_TAG}\$") & ~last.rlike(rf"^{_DOLLAR}\z"),
            F.format_string(OPEN_DOLLAR, F.regexp_extract(last, rf"^\$({_TAG})\$", 1)),
        )
    )


def split(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``statements`` (array, null on error) and ``split_error`` for each script.

    ``content`` holds bytes or text; null stays null.  The steps are columns of their
    own, so that each is computed once per script.
    """
    text, nested = F.col("_text"), F.col("_nested")
    raw = F.col(content).cast("string")
    flat, deep = _around(_FLAT_COMMENT), _around(F.col("_comment"))
    more = F.greatest(F.col("_depth"), F.lit(1)) - 1
    comment = F.concat(
        F.repeat(F.lit(rf"/\*(?:{_IN_COMMENT}|"), more), F.lit(_FLAT_COMMENT), F.repeat(F.lit(r")*+\*/"), more)
    )
    inner = F.exists(
        "_pieces",
        lambda p: F.startswith(p, F.lit("/*")) & F.contains(F.substr(p, F.lit(3)), F.lit("/*")),
    )

    def runs(closed: Column, by: dict[str, Column]) -> Column:
        found = F.transform(
            F.when(closed, F.regexp_extract_all(text, by["run"], F.lit(0))),
            lambda s: F.btrim(F.regexp_replace(s, by["leading"], F.lit("")), F.lit(WHITE_SPACE)),
        )
        return F.filter(found, lambda s: s != "")

    def error(pieces: str, by: dict[str, Column]) -> Column:
        return _open_piece(F.try_element_at(pieces, F.lit(-1)), by["comment"])

    closed, closed_deep = F.col("_closed"), F.col("_closed_deep")
    too_deep = F.col("_depth") > DEEPEST
    return (
        df.withColumn("_text", F.when(F.is_valid_utf8(raw), raw))
        .withColumn("_closed", F.rlike(text, flat["whole"]))
        .withColumn("_pieces", F.when(~closed, F.regexp_extract_all(text, flat["pieces"], F.lit(0))))
        .withColumn("_nested", F.coalesce(inner, F.lit(False)))
        .withColumn("_depth", F.when(nested, _nesting(text)))
        .withColumn("_comment", F.when(~too_deep, comment))
        .withColumn("_closed_deep", F.when(F.col("_comment").isNotNull(), F.rlike(text, deep["whole"])))
        .withColumn("_pieces_deep", F.when(~closed_deep, F.regexp_extract_all(text, deep["pieces"], F.lit(0))))
        .withColumn("statements", F.when(nested, runs(closed_deep, deep)).otherwise(runs(closed, flat)))
        .withColumn(
            "split_error",
            F.when(text.isNull() & F.col(content).isNotNull(), NOT_TEXT)
            .when(too_deep, TOO_DEEP)
            .when(nested, F.when(~closed_deep, error("_pieces_deep", deep)))
            .when(~closed, error("_pieces", flat)),
        )
        .drop("_text", "_closed", "_pieces", "_nested", "_depth", "_comment", "_closed_deep", "_pieces_deep")
    )


def verdict(df: DataFrame) -> DataFrame:
    """Replace ``statements`` and ``split_error`` by ok, statements (count), error.

    An empty script is an error too.
    """
    count = F.coalesce(F.size("statements"), F.lit(0)).cast("bigint")
    error = F.when(
        F.col("split_error").isNotNull(), F.concat(F.lit(CANNOT_SPLIT), "split_error")
    ).when(F.col("_count") <= 0, NO_STATEMENTS)
    return (
        df.withColumn("_count", count)
        .withColumn("error", error)
        .withColumn("statements", F.greatest("_count", F.lit(0)))
        .withColumn("ok", F.col("error").isNull())
        .drop("_count", "split_error")
    )
