"""Splitting: hand-written cases, and both ways of splitting against each other."""

import random

from plain_split import split_nested_text

from tidemark.functions import statements as st
from tidemark.sources import scripts as sc

# One piece for every lexical state, each with a semicolon that must not cut.
PIECES = [
    "'north; south'", "'harbour''s; gate'", "''", r"E'quay\';7'", r"e'\\'", r"'back\'", r"typeE'\'", '"tide;table"', '"a "";"" b"',
    "$$ pilot; $$", "$log$ crew; $$ mate; $$ $log$", "$_1$;$_1$", "$3", "/* fog; */", "/* outer /* inner; */ ; */", "-- rain; wind\n", "6 - 2 / 3", "`",
]
FRAMES = [("", ""), ("-- log of the day\n", ""), ("/* log; */\n", " "), (" \t\n", "\n"), ("\u2003", "\x0c"), ("", "/* signed */"), ("", "-- signed;\n")]


def build():
    """Every piece in a statement, alone in every frame and before every other piece."""
    cases = [("", []), (";", []), ("\n;; \t;", []), ("-- all quiet", []), ("/* one */ -- two\n", [])]
    for piece in PIECES:
        statement = f"moor {piece} now"
        for lead, tail in FRAMES:
            kept = tail.strip() and statement + tail.rstrip("\n")
            cases.append((lead + statement + tail, [kept or statement]))
            cases.append((f"{lead}{statement};{tail}", [statement]))
        for other in PIECES:
            second = f"sail {other} out"
            cases.append((f"{statement};{second}", [statement, second]))
    return cases


CASES = build()
# What stays open at the end, and how it is named, after each piece that closes.
OPENERS = [
    ("'anchor", st.OPEN_STRING), ("'anchor''", st.OPEN_STRING), (r"E'anchor\'", st.OPEN_STRING), ('"anchor', st.OPEN_IDENTIFIER),
    ("/* anchor", st.OPEN_COMMENT), ("/*/", st.OPEN_COMMENT), ("/* a /* b */", st.OPEN_COMMENT), ("$$ anchor", st.OPEN_DOLLAR % ""),
    ("$keel$ anchor $hull$", st.OPEN_DOLLAR % "keel"),
]
BROKEN = [(f"moor {piece} now; {opener}", error) for piece in ("", *PIECES) for opener, error in OPENERS]


def split_all(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    rows = st.split(df).orderBy("i").collect()
    return [(r.statements, r.split_error) for r in rows]


def test_cases(spark):
    got = split_all(spark, [t for t, _ in CASES])
    for (text, expected), result in zip(CASES, got):
        assert result == (expected, None), text


def test_broken(spark):
    got = split_all(spark, [t for t, _ in BROKEN])
    for (text, expected), result in zip(BROKEN, got):
        assert result == (None, expected), text


def test_helper_cases():
    for text, expected in CASES:
        assert split_nested_text(text) == (expected, None), text


def test_helper_broken():
    for text, expected in BROKEN:
        assert split_nested_text(text) == (None, expected), text


def test_both_ways_agree_on_random_scripts(spark):
    """Every random script is split by the expressions and by the helper."""
    rng = random.Random(11)
    parts = ["'", "''", '"', ";", "--", "\n", "/*", "*/", "/", "*", "-", "$", "$$", "$a$", "$1", "E'", "e'", "xE'", "\\", "\\'", " ", "é", "a", "_", "1", "\t", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    for text, got in zip(texts, split_all(spark, texts)):
        assert got == split_nested_text(text), text


def test_comments_nest_to_any_depth(spark):
    deep = lambda n: "/* a; " * n + "'" + " b; */" * n
    texts = [
        f"x; {deep(40)}; y '{deep(2)}', /*/ ; /* '*/ ; */ */ 1; z", f"{deep(st.DEEPEST)} z; u", f"{deep(9)} /* /* */ ; z", "a /* /* */; b",
        "select '*/' /* one /* two */ ; */; '/*' ; -- /* /*\nq", deep(st.DEEPEST + 1),
    ]
    got = split_all(spark, texts)
    for text, found in zip(texts[:-1], got):
        assert found == split_nested_text(text), text[:60]
    assert got[-1] == (None, st.TOO_DEEP)


def test_scripts_never_leave_the_jvm(spark):
    df = spark.createDataFrame([("a /* /* */ */",)], "content string")
    plan = st.verdict(st.split(df))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_long_scripts(spark):
    """No limit on the length of a script or of its pieces."""
    many = "INSERT INTO t VALUES (E'a\\'b', 'it''s', \"q\", $$x;y$$); -- c;\n" * 20000
    quoted = "SELECT '" + "''" * 300000 + "'; SELECT E'" + "\\'" * 300000 + "'; SELECT 3"
    header = "-- a comment line; with a cut\n" * 50000 + "SELECT 1;"
    got = split_all(spark, [many, quoted, header])
    assert [(len(s), e) for s, e in got] == [(20000, None), (3, None), (1, None)]


def test_statements_and_verdicts(spark):
    files = spark.createDataFrame(
        [("a", "1", bytearray(b"x; y")), ("a", "2", bytearray(b"-- only")), ("a", "3", bytearray(b"'")), ("b", "1", bytearray(b"\xff;"))],
        "db_id string, name string, content binary",
    )
    rows = sc.statements(files).orderBy("db_id", "name", "pos").collect()
    assert [(r.db_id, r.name, r.pos, r.statement) for r in rows] == [("a", "1", 0, "x"), ("a", "1", 1, "y")]
    got = {(r.db_id, r.name): (r.ok, r.statements, r.error) for r in sc.verdicts(files).collect()}
    assert got == {
        ("a", "1"): (True, 2, None),
        ("a", "2"): (False, 0, st.NO_STATEMENTS),
        ("a", "3"): (False, 0, st.CANNOT_SPLIT + st.OPEN_STRING),
        ("b", "1"): (False, 0, st.CANNOT_SPLIT + st.NOT_TEXT),
    }


def test_import_markers_are_comments(spark):
    text = 'CREATE TABLE "a" (\n\tid int\n);\n--> next-part\nCREATE TABLE "b" (id int);--> next-part\nCREATE INDEX i ON "a" (id);'
    (found, error), = split_all(spark, [text])
    assert error is None and len(found) == 3 and not any("next-part" in s for s in found)


def test_split_is_computed_once(spark):
    df = spark.createDataFrame([("a", "1", "x;y")], "db_id string, name string, content string")
    plan = sc.statements(df)._jdf.queryExecution().optimizedPlan().toString()
    # The runs and the pieces of open scripts, both also for nested comments, and their edges.
    assert plan.count("regexp_extract_all") <= 5
