"""Alignment of two tokenizers against plain tokenizers and nested loops over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import alignment

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    path_a, path_b = alignment.vocabularies()
    a = tokenizers.Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b)


def byte_of():
    """The byte-level alphabet, printable bytes as they are and the others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens(plain, text):
    """Spans and ids of both sides, or None where they do not give the text's bytes."""
    a, b = plain
    alphabet, body = byte_of(), (" " + text).encode()
    one = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        two.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if not text or any(b"".join(x for _, x in side) != body for side in (one, two)):
        return None
    out = []
    for side in (one, two):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def by_hand(plain, rows):
    found = [tokens(plain, t) if t else None for _, t in rows]
    met = [Counter((i, j) for i, s, e in f[0] for j, u, v in f[1] if s < v and u < e) if f else Counter() for f in found]
    held = Counter(p for m in met for p in m)
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for (key, _), f, m in zip(rows, found, met):
        if not f:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, _, e in f[0]} & {e for _, _, e in f[1]})
        groups = []
        for low, high in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in f))
        best = sum(n for p, n in m.items() if held[p] == top[p[0]])
        total = sum(n * held[p] for p, n in m.items())
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((key, len(f[0]), len(f[1]), len(groups), m.total(), best, total, sha))
    return sorted(out, key=str)


TEXTS = [
    "", " ", "a", "unbelievable tokenization", "  two  spaces ", "tab\tand\r\nlines\n\n x\ny", "<|endoftext|> and </s> <unk> <0x41>.", "x ▁ y",
    "日本語 テキスト", "\U0001f600\U0001f468‍\U0001f469 é \xa0 ﬁ \x00 ​", "word " * 3000, "abc" * 4000, "don't stop 12345 3.14, O'Neil's _under_score_", "\n", "a\n", "\nb",
]


@pytest.mark.parametrize("head", [400_000, 50])
def test_alignment(spark, plain, head):
    rng = random.Random(2)
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(rng.choices("ab1.' \n\té ,THe", k=50))) for i in range(60)]
    rows += [rows[3], (None, "no id"), (900, None), (901, "unbelievable"), (902, "unbelievable words")]
    docs = spark.createDataFrame([(*r, "x", 1, [1]) for r in rows], "doc_id bigint, text string, n_a string, row int, pairs array<int>")
    found = alignment.aligned(docs.repartition(3), *alignment.vocabularies())
    got = [tuple(r) for r in alignment.measured(found, head).collect()]
    assert sorted(got, key=str) == by_hand(plain, rows)


def test_groups_are_listed(spark, plain):
    docs = spark.createDataFrame([(1, "tokenizers disagree, 日 often")], "doc_id bigint, text string")
    row = alignment.aligned(docs, *alignment.vocabularies(), with_groups=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] == by_hand(plain, [(1, "tokenizers disagree, 日 often")])[0][-1]


def test_successors_lead_to_the_component_end():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        cut = lambda: np.r_[np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)) if n > 1 else [], n].astype(int)
        a, b = cut(), cut()
        of_a, of_b = alignment.terminals(a, b)
        common = np.intersect1d(a, b)
        assert (b[of_a - len(a)] == common[np.searchsorted(common, a)]).all()
        assert (b[of_b - len(a)] == common[np.searchsorted(common, b)]).all()
        spans = [list(zip(np.r_[0, x[:-1]], x)) for x in (a, b)]
        want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert list(zip(*(x.tolist() for x in alignment.links(a, b)))) == want


def test_chunks_are_forgotten_in_two_generations(plain, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    aligner = alignment.Aligner(*alignment.vocabularies())
    rng = random.Random(4)
    for _ in range(200):
        texts = [" ".join(rng.choices(["one", "two,", "three", "▁", "fünf", "six"], k=4)) for _ in range(2)]
        for text, found in zip(texts, aligner.align(texts)):
            want = tokens(plain, text)
            assert (found is None) == (want is None)
            if found:
                assert found[0][:2] == [len(want[0]), len(want[1])]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.measured(alignment.aligned(docs, *alignment.vocabularies())).count() == 0
