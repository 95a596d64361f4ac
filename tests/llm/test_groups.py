"""Decontamination, near-duplicates and substrings against brute force; odd inputs."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import decontaminate, links, neardup, substrings

VOCABULARY = [f"w{i}" for i in range(40)] + ["É", "ß9", "the", "The"]


def corpus(seed, n=120):
    """Random texts with copies, near copies and shared passages; ids in no order."""
    rng = random.Random(seed)
    ids = rng.sample(range(1000), n)
    shared = [" ".join(rng.choices(VOCABULARY, k=rng.randint(10, 40))) for _ in range(4)]
    out = []
    for i in ids:
        kind = rng.random()
        words = rng.choices(VOCABULARY, k=rng.randint(0, 90))
        if kind < 0.3 and out:
            words = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        elif kind < 0.6:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(shared).split()
        out.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    return out, shared


def frame(spark, rows):
    extra = "n_words string, items int, start int, bands int, place int, shingles int, node int"
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows], f"doc_id bigint, text string, {extra}")


ODD = [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "one two"), (None, "no id at all"), (2005, "w1 w2 " * 3000)]


def alnum(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination(spark, block):
    rows, shared = corpus(1)
    rows += ODD
    items = [(10, shared[0]), (9, shared[1] + " tail words"), (9, shared[2]), (11, "w1 W2"), (12, "w3"), (13, None), (14, ""), (None, shared[3]), (10, shared[0])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.mark(frame(spark, rows), bench, block=block)).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        words = alnum(text)
        hit, found = set(), set()
        for item, body in items:
            own = alnum(body)
            size = min(10, len(own))
            for a in range(len(own) - size + 1 if size else 0):
                for b in range(len(words) - size + 1):
                    if words[b : b + size] == own[a : a + size]:
                        hit.update(range(b, b + size))
                        found.add(item)
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        r = got[key]
        assert (r["n_words"], r["n_hit"], r["contaminated"]) == (len(words), len(hit), bool(hit)), key
        assert r["items_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    kept = decontaminate.clean(frame(spark, rows), bench, block=block)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(k or -1 for k in got if not got[k]["contaminated"])


def test_decontamination_of_empty_tables(spark):
    docs, none = frame(spark, ODD), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.mark(docs, none).where("size(spans) > 0").count() == 0
    assert decontaminate.mark(docs.limit(0), none).count() == 0
    assert decontaminate.clean(docs, none).count() == len(ODD)


def classes(rows, size=3, percent=85):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and None not in (rows[a][0], rows[b][0]) and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    return [(key, len(sets[i]), min(least[find(i)]) if key is not None else None) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("seed,percent,centres", [(3, 85, 16), (4, 60, 1)])
def test_near_duplicates(spark, seed, percent, centres):
    rows, _ = corpus(seed, 90)
    rows += ODD + [rows[0], rows[0]]
    bands, per = (32, 6) if percent == 85 else (64, 3)
    out = neardup.group(frame(spark, rows), percent=percent, bands=bands, rows=per, centres=centres).collect()
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out)
    assert got == sorted((str(k), n, str(c)) for k, n, c in classes(rows, percent=percent))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_of_nothing(spark):
    assert neardup.group(frame(spark, ODD).limit(0)).count() == 0
    assert neardup.group(frame(spark, ODD[:3])).count() == 3


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.unique(pool[:700]), np.unique(pool[200:])
    agree = np.mean(neardup.super_minhash(a, 192) == neardup.super_minhash(b, 192))
    assert abs(agree - 500 / 900) < 0.12
    few = neardup.super_minhash(a[:1], 64)
    assert sorted(few.astype(int)) == list(range(64))
    assert (neardup.super_minhash(a, 64, chunk=50) == neardup.super_minhash(a, 64)).all()


def cut(rows, window):
    first = {}
    for key, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            if key is not None:
                w = tuple(words[i : i + window])
                first[w] = min(first.get(w, key), key)
    out = []
    for key, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if key is not None and first[tuple(words[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((str(key), len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed,common", [(5, 100_000), (6, 1)])
def test_substrings(spark, seed, common):
    rows, shared = corpus(seed)
    rows += [(k, t) for k, t in ODD] + [rows[0], (2100, "w1 w2 " * 3000), (1999, "w1 w2 " * 20)]
    rows += [(3000 + i, " ".join(random.Random(i).choices(VOCABULARY, k=20)) + " " + shared[0]) for i in range(60)]
    random.Random(1).shuffle(rows)
    out = substrings.remove(frame(spark, rows).repartition(5), common=common, shard_rows=20)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect())
    assert got == cut(rows, 13)


def test_hot_anchors_are_dealt_by_window(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choices(VOCABULARY, k=15)) + " " + " ".join(VOCABULARY[:30])) for i in range(40)]
    seen = []
    real = substrings.segments
    monkeypatch.setattr(substrings, "segments", lambda *a: seen.append(a[4]) or real(*a))
    out = substrings.remove(frame(spark, rows).repartition(8), common=5)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect())
    assert got == cut(rows, 13) and seen[0]


def test_substrings_of_nothing(spark):
    assert substrings.remove(frame(spark, ODD).limit(0)).count() == 0
    assert [r["n_removed"] for r in substrings.remove(frame(spark, ODD[:5])).collect()] == [0] * 5


def test_backward_search():
    rng = np.random.default_rng(0)
    for _ in range(30):
        text = np.r_[rng.integers(1, rng.integers(2, 9), 300), 0]
        size = int(rng.integers(1, 14))
        starts = np.flatnonzero(np.arange(len(text)) <= len(text) - 1 - size)
        rows, low, high = substrings.FMIndex(text, 13).shared(starts, size)
        found = dict(zip(starts[rows].tolist(), (high - low).tolist()))
        grams = [tuple(text[i : i + size]) for i in starts]
        assert found == {i: grams.count(g) for i, g in enumerate(grams) if grams.count(g) > 1}


def test_word_hashes_against_a_plain_version():
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(33, 256, n).astype(np.uint8)) for n in [*range(1, 40), 127, 128, 129, 500] * 3]
    words += [b"a", b"a\0", b"a" + bytes(7), b"a" + bytes(8), b"x" * 8, b"x" * 16]

    def mixed(x):
        for shift, times in ((30, links.MIX[1]), (27, links.MIX[2])):
            x = ((x ^ (x >> shift)) * int(times)) % 2**64
        return x ^ (x >> 31)

    def plain(word):
        if len(word) > 128:
            return xxhash.xxh3_64_intdigest(word)
        out = len(word)
        for at in range(0, len(word), 8):
            out = mixed((out * int(links.MIX[0]) + int.from_bytes(word[at : at + 8], "little")) % 2**64)
        return out

    for texts in ([], [[]], [[], [words[5]], []], [words[k::7] for k in range(7)], [words, [], words[::-1]]):
        assert [own.tolist() for own in links.word_hashes(texts)] == [[plain(w) for w in own] for own in texts]
    assert len(set(np.concatenate(links.word_hashes([words])).tolist())) == len(set(words))


def test_backward_search_begins_with_eight_words(monkeypatch):
    """All thirteen steps went through the wavelet matrix, for windows that occur once too."""
    text = np.random.default_rng(7).integers(1, 5, 3000)
    text[-1] = 0
    index, steps, once = substrings.FMIndex(text, 13), [], substrings.FMIndex._down
    monkeypatch.setattr(substrings.FMIndex, "_down", lambda self, symbol, at: (steps.append(len(at)), once(self, symbol, at))[1])
    starts = np.arange(len(text) - 13)
    rows, low, high = index.shared(starts, 13)
    assert len(steps) == 10 and steps[0] < len(starts)
    where = {}
    for k in starts.tolist():
        where.setdefault(tuple(text[k : k + 13].tolist()), []).append(k)
    assert {k: sorted(index.order[a:b].tolist()) for k, a, b in zip(rows.tolist(), low, high)} == {k: own for own in where.values() if len(own) > 1 for k in own}
