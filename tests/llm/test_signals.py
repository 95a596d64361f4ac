"""Secret scans, quality rules, license scans and HTML: brute force and odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html, licenses, quality, secrets

ODD = [
    (1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "one", "x"), (4, "one", "x"), (None, "no id here", "x"),
    (5, "a b c " * 4000, "x"), (6, "Kelvin MKT license İ", "x"),
]


def odd(spark, extra="words"):
    return spark.createDataFrame(ODD, f"doc_id bigint, text string, {extra} string")


def spans_of(text):
    found = []
    assign = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, pattern, ok in (
        ("assign", assign, lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m)]
    return [x for *_, x in sorted(found)]


def test_fixed_patterns(spark):
    rng = random.Random(2)
    bits = ["password", "Token", "API_KEY", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABCD1234EFGH5678", "0a1b2c3d4e5f6a7b8c9d0e1f", "é", "\n", "x9", "ſecret", "toKen"]
    rows = [(i, "".join(rng.choices(bits, k=14)), "w") for i in range(400)]
    rows += [(500 + i, *r[1:]) for i, r in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert len(got) == len(rows)
    for key, text, _ in rows:
        want = spans_of(text or "")
        assert got[key]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[key][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert [s for s in got[key]["spans"].split(",") if s and not s.startswith("entropy")] == want


def test_incremental_entropy_equals_the_plain_one():
    rng = random.Random(4)
    mix = (frozenset("0123456789"), frozenset("abcdef"))
    for _ in range(300):
        run = "".join(rng.choices("0123456789abcdef", k=rng.randint(0, 60)))
        covered = set()
        for at in range(len(run) - 19):
            part = run[at : at + 20]
            entropy = -sum(part.count(c) / 20 * math.log2(part.count(c) / 20) for c in set(part))
            if entropy >= 3.0 - 1e-9 and all(set(part) & m for m in mix):
                covered.update(range(at, at + 20))
        spans = secrets.high_entropy(run, 20, 3.0, mix)
        assert {i for a, b in spans for i in range(a, b)} == covered


def test_single_case_keys_and_keys_behind_allowed_words():
    rng, scanner = random.Random(6), secrets.Scanner()
    for chars in ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        for _ in range(50):
            key = "".join(rng.sample(chars, 24)) + "".join(rng.choices(chars, k=8))
            if re.search("[0-9]", key[:24]):
                assert ("entropy", 4, 36) in [(k, a, max(b, 36)) for k, a, b in scanner.entropy(f"key {key} end")]
    key = "k9XvQ2mZr7LtB4wYs8HnC1pD6"
    for before in ("example/", "sample-", "docs/example_", "xxxx-"):
        (_, start, end), = scanner.entropy(before + key)
        assert start <= len(before) < end == len(before + key)
    for known in (f"sample{key}", "example/path/to/some/longer/file", "internationalisation2026", "XXXXXXXX" + key):
        assert scanner.entropy(known) == []
    assert scanner.entropy("x" * 200_000 + "/" + "sample" * 30_000 + "/sample" * 30_000) == []
    assert scanner.entropy("Ab1" * 100_000) == []


def test_allow_list_and_redaction(spark):
    key = "k9XvQ2mZr7LtB4wYs8HnC1pD6"
    rows = [
        (1, f"see {key}!"), (2, "id 123e4567-e89b-12d3-a456-426614174000"), (3, f"EXAMPLE{key}"),
        (4, "antidisestablishmentarianism thinghaesthrevering"), (5, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(docs).collect()}
    assert got == {1: ["entropy"], 2: [], 3: [], 4: [], 5: []}
    masked = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert masked == {**dict(rows), 1: "see [secret]!"}
    assert secrets.scan(docs.limit(0)).count() == 0


def repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_quality_counts(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices(["a ", "b ", "c\n", "d\t", "#", "é ", "|", "\x0b", " "], k=rng.randint(0, 60))), 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lines int")
    for r in quality.judge(docs).collect():
        text = rows[r["doc_id"]][1]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(words)
        assert r["base_failed"] == (len(words) < 50 or 100 * repeated(words) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_quality_verdicts(spark):
    good = "\n".join(" ".join(f"{w}{i}" for w in "the quick brown fox jumps over lazy dogs".split()) + "." for i in range(8))
    menu = "\n".join(f"Home | News{i} | Sport{i} | Weather{i} | Travel{i} | Opinion{i} | Contact{i}" for i in range(8))
    loud = "\n".join(f"BUY THE THING NUMBER X{i} RIGHT AWAY BEFORE IT GOES TO SOMEONE{i} ELSE!" for i in range(8))
    rows = [(1, good), (2, menu), (3, loud), (4, good + "\n" + menu[:60]), (5, "too short."), (6, None)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {k: r["kept"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    assert got[4]["clean_text"] == good


def test_odd_rows_of_native_scans(spark):
    assert quality.judge(odd(spark)).count() == licenses.scan(odd(spark)).count() == len(ODD)
    assert quality.judge(odd(spark).limit(0)).count() == licenses.scan(odd(spark).limit(0)).count() == 0
    kelvin = licenses.scan(odd(spark).where("doc_id = 6")).first()
    assert (kelvin["n_words"], kelvin["n_base"]) == (4, 0)


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License. MIT-License mit license"), (2, "GNU General Public License, version 3; Apache License"),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (4, "any person may obtain a copy of the license"), (5, "CC BY-NC 4.0 licensed under cc  by"), (6, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (3, 3, 7)
    assert got[1]["labels"] == "mit,mit-notice"
    assert got[2]["base_labels"] == "apache,gpl" and (got[2]["first_word"], got[2]["last_word"]) == (0, 6)
    assert got[3]["labels"] == "mit-text" and got[3]["score"] == 1.0 and got[3]["base_labels"] == ""
    assert got[4]["labels"] == "" and got[4]["score"] == 0.0 and got[4]["first_word"] is None
    assert got[5]["n_base"] == 2 and "cc-by" in got[5]["labels"]
    assert got[6]["labels"] == "cc-by,cc-by-nc-4.0"
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), licenses.TEMPLATES * 200)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header>Site name <a href="/">home</a></header><nav><ul><li><a>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id="ads">Buy</div><aside>Side</aside>
<main><article><h1>Head&amp;line</h1><p>First <b>bold</b>   text.<br>Next</p><p>Un<i>closed<p>Last&nbsp;one.
<form>Search <input></form></article></main><section class="comments"><p>Reader says so.</p></section>
<footer>&copy; us</footer></body></html>"""


def test_html_article():
    assert html.main_text(PAGE) == "Head&line\nFirst bold text. Next\nUnclosed\nLast one."


def test_html_without_article():
    body = "".join(f"<p>Paragraph {i} has a good many words that tell of something worth reading at length.</p>" for i in range(6))
    links = "".join(f"<div><a href=x>L{i}</a> <a>M</a> <a>N</a></div>" for i in range(9))
    page = f"<html><body><div>{links}</div><div>{body.replace('3 has', '3. Short</p><p>It has')}</div><div>{links}</div></body></html>"
    text = html.main_text(page)
    assert text.startswith("Paragraph 0") and text.count("\n") == 6 and "L1" not in text and "Short" in text


LONG = "<p>Paragraph %d has a good many words that tell of something worth reading at length, and goes on so.</p>"


def test_html_line_breaks_and_hidden_elements():
    body = "<p>" + "Plain words in a sentence. " * 12 + "</p>"
    extra = (
        "<p>one<br>two<br/>three and so on, in one block of the text</p><p hidden>gone <b>with</b> it</p><p>Some <span style='color:red; DISPLAY : none'>secret "
        "<span>inner</span> words</span>shown words that go on for a while</p><p hidden>never closed<p>After it comes another paragraph of the text</p>"
        "<section style='visibility:hidden'><p>unseen</p></section><i hidden>x</i>"
    )
    lines = html.main_text(f"<body><div>{body}{extra}{body}</div></body>").split("\n")
    assert lines[1:-1] == [
        "one two three and so on, in one block of the text", "Some shown words that go on for a while", "After it comes another paragraph of the text",
    ]


def random_page(rng):
    """A page without any telling tag, and the words of its article."""
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    links = lambda n: "<div>" + "".join(f"<p><a href='#'>{words(rng.randint(1, 3))}</a></p>" for _ in range(n)) + "</div>"
    parts, truth = [], []
    for _ in range(rng.randint(6, 25)):
        text = words(rng.choice([4, 12, 30, 60, 90]))
        truth += text.split()
        first, rest = text.split(" ", 1)
        parts.append(rng.choice([f"<p>{text}</p>", f"<p><b>{first}</b> {rest}</p>", f"<p><a href='#'>{first}</a> {rest}</p>"]))
    return f"<body>{links(rng.randint(4, 15))}<div>{''.join(parts)}</div>{links(rng.randint(6, 20))}<div><p>{words(5)}</p></div></body>", truth


def test_html_clustering_alone_finds_the_article():
    rng = random.Random(8)
    both = found = wanted = 0
    for _ in range(200):
        page, truth = random_page(rng)
        got, want = Counter(html.main_text(page, hints=False).split()), Counter(truth)
        both, found, wanted = both + (got & want).total(), found + got.total(), wanted + want.total()
    assert both >= 0.97 * wanted and both >= 0.97 * found, (both / wanted, both / found)


def plain_text(page):
    """The same rules for pages of closed divs and paragraphs, written over again with a regular expression."""
    lines = []
    for block in re.findall(r"<p>(.*?)</p>", page):
        text = " ".join(re.sub(r"<[^>]+>", "", block).split())
        linked = sum(map(len, re.findall(r"<a[^>]*>(.*?)</a>", block)))
        lines.append((text, max(len(text) - 2 * linked, 0), len(re.findall(r"<", block)) + 1, linked))
    ratios = [n / tags for _, n, tags, _ in lines]
    kernel = [math.exp(-0.5 * (k / html.SIGMA) ** 2) for k in range(-9, 10)]
    smooth = []
    for i in range(len(ratios)):
        near = [(ratios[i + k - 9], w) for k, w in enumerate(kernel) if 0 <= i + k - 9 < len(ratios)]
        smooth.append(sum(r * w for r, w in near) / sum(w for _, w in near))
    cut = html.ENOUGH * html.threshold(np.array(smooth))
    high = [i for i, r in enumerate(smooth) if r >= cut]
    keep = {j for a, b in zip(high, high[1:] + high[-1:]) for j in (range(a, b) if b - a <= html.GAP + 1 else [a])} | set(high)
    return "\n".join(t for i, (t, _, _, linked) in enumerate(lines) if i in keep and 2 * linked <= len(t))


def test_html_against_a_plain_version():
    rng = random.Random(9)
    for _ in range(60):
        page, _ = random_page(rng)
        assert html.main_text(page) == plain_text(page)


def test_html_article_is_a_hint_only():
    body = "".join(LONG % i for i in range(6))
    teaser = "<article><a href=x>More</a> <a href=y>of</a> <a href=z>it</a></article>"
    text = html.main_text(f"<body><div>{body}</div>{teaser}</body>")
    assert text.startswith("Paragraph 0") and "\nParagraph 5" in text
    links = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(12))
    steps = "".join(f"<li>Step {i}</li>" for i in range(12))
    text = html.main_text(f"<body><main><h1>Title</h1>{body}<ol>{steps}</ol><p>End</p><div>{body}</div><ul>{links}</ul></main></body>")
    assert text.startswith("Title\nParagraph 0") and "\nStep 6\n" in text and "\nEnd\n" in text and "Link 9" not in text


def test_html_computes_ratios_of_every_page(monkeypatch):
    seen, real = [], html.smoothed
    monkeypatch.setattr(html, "smoothed", lambda r, sigma: seen.append(len(r)) or real(r, sigma))
    html.main_text(PAGE)
    assert seen and seen[0] >= 4


@pytest.mark.parametrize("name", ["layout has-sidebar", "content-with-sidebar", "right-side", "search-results", "post-share", "no-comments", "sidebar", "widget"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_html_marked_wrapper_keeps_main_text(name, inner):
    body = "".join(LONG % i for i in range(6))
    text = html.main_text(f"<body><div class='{name}'><{inner}>{body}</{inner}><div class='comments'><p>Reader says.</p></div></div></body>")
    assert text.startswith("Paragraph 0") and "\nParagraph 5" in text and "Reader" not in text


@pytest.mark.parametrize("name", ["ad", "site-footer", "main-nav", "cookie-notice", "comments-area", "related", "Sidebar left"])
def test_html_marks_beside_the_main_text(name):
    body = "".join(LONG % i for i in range(6))
    for inner in ("article", "div"):
        text = html.main_text(f"<body><{inner}>{body}</{inner}><div class='{name}'><article><p>{'Other ' * 20}</article></div></body>")
        assert text.startswith("Paragraph 0") and "\nParagraph 5" in text
        assert inner == "div" or "Other" not in text


def test_html_odd(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>x", "t"), (3, "u", "<p>x", "t"), (None, "u", "<!-- open", "t"), (5, "u", "plain &lt; text", "t"), (6, "u", "<p>" + "word " * 60_000, "t")]
    out = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    got = sorted((r["page_id"] or 0, r["text"][:20], r["n_chars"]) for r in out.collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1), (5, "plain < text", 12), (6, ("word " * 4), 299_999)]
    assert html.extract(out.selectExpr("page_id", "url", "text html").where(F.lit(False))).count() == 0
