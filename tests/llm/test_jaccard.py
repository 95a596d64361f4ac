"""The set join and its parts against nested loops; parities lose nothing."""

import random
from collections import Counter
from itertools import combinations
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_groups import ODD, classes, corpus, frame
from tidemark.llm import jaccard, links

PERCENT = 90


def families(seed, n=160, size=(4, 60)):
    """Texts of distinct words, each the copy of one of a few with little changed."""
    rng = random.Random(seed)
    bases = [[f"{b}x{i}" for i in range(rng.randint(*size))] for b in range(8)]
    out = []
    for i in rng.sample(range(1000), n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            kind, at = rng.random(), rng.randrange(len(words))
            if kind < 0.4:
                words[at] = f"n{rng.randrange(6)}"
            elif kind < 0.7 and len(words) > 1:
                del words[at]
            else:
                words.append(f"e{rng.randrange(4)}")
        out.append((i, " ".join(words)))
    return out


def rows_of(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def want(rows, percent=PERCENT):
    return sorted((str(k), n, str(c)) for k, n, c in classes(rows, percent=percent))


@pytest.mark.parametrize("seed,percent,centres,size", [(1, 90, 16, (4, 60)), (2, 90, 2, (3, 26)), (3, 75, 4, (3, 40))])
def test_components(spark, seed, percent, centres, size):
    rows = families(seed, size=size) + corpus(seed, 40)[0]
    rows = list({k: (k, t) for k, t in rows}.values()) + ODD + [rows[0]]
    got = jaccard.join(frame(spark, rows).repartition(3), percent=percent, centres=centres)
    assert rows_of(got) == want(rows, percent)


@pytest.mark.parametrize("boundary", [0, 12, 20, 30])
def test_every_boundary_gives_the_same(spark, boundary, monkeypatch):
    rows = families(7, 80, (8, 36))
    monkeypatch.setattr(jaccard, "chosen_boundary", lambda *_: boundary)
    assert rows_of(jaccard.join(frame(spark, rows))) == want(rows)


def test_the_boundary_follows_the_cost():
    sizes = {12: (10, 9_000), 20: (10, 9_000), 28: (10, 9_000)}
    assert jaccard.chosen_boundary(sizes, PERCENT) == 12
    assert jaccard.chosen_boundary({k: (n, 10**9) for k, (n, _) in sizes.items()}, PERCENT) == 28
    assert jaccard.chosen_boundary({k: (n, 0) for k, (n, _) in sizes.items()}, PERCENT) == 0
    assert jaccard.chosen_boundary({}, PERCENT) == 0


def test_all_links_between_representatives(spark):
    rows = families(11, 120)
    rows += [rows[0], (5000, rows[1][1]), (5001, None), (None, rows[2][1])]
    sets = {}
    for key, text in rows:
        w = (text or "").split()
        k = min(3, len(w))
        s = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
        if s and key is not None:
            sets[s] = min(sets.get(s, key), key)
    links_, members = jaccard.pairs(frame(spark, rows))
    found = []
    for (s, i), (t, j) in combinations(sets.items(), 2):
        both = len(s & t)
        if 100 * both >= PERCENT * len(s | t):
            (i, s), (j, t) = sorted([(i, s), (j, t)], key=lambda x: x[0])
            found.append((i, j, both, len(s), len(t)))
    assert sorted(tuple(r) for r in links_.collect()) == sorted(found)
    assert members.count() == len(rows) - 1
    assert members.where("representative < doc_id").count() >= 1


def test_subsets_are_shared_exactly_by_similar_sets():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = sorted(rng.integers(1, 24, 2).tolist())
        both = int(rng.integers(max(0, n - 3), n + 1))
        pool = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
        one, two = pool[:n], pool[n - both :]
        keys = [set(zip(*(k.tolist() for k in jaccard.subset_keys(s, PERCENT)))) for s in (one, two)]
        need = jaccard.needed(n, m, PERCENT)
        assert need == ceil(PERCENT * (n + m) / (100 + PERCENT))
        shares = any(k[0] >= need for k in keys[0] & keys[1])
        assert shares == (100 * both >= PERCENT * (n + m - both))


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 20, 500, 5000):
        pool = rng.integers(0, 2**63, n + 40, dtype=np.uint64)
        for k in range(0, 41, 5):
            a, b = pool[:n], pool[k : n + k]
            bits = sum(int(x).bit_count() for x in (links.parity(a) ^ links.parity(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b)) and (k or not bits)
            assert n > 100 or bits >= 0.75 * len(np.setxor1d(a, b))


def test_folded_parities_are_those_by_fewer_residues(spark):
    elements = np.random.default_rng(5).integers(0, 2**63, 300, dtype=np.uint64)
    row = spark.createDataFrame([(links.parity(elements).tolist(),)], "bits array<bigint>").select(*links.folded(F.col("bits"))).first()
    assert list(row) == links.parity(elements, words=2).tolist()


def test_no_documents(spark):
    assert jaccard.join(frame(spark, ODD).limit(0)).count() == 0
    assert jaccard.join(frame(spark, ODD[:3])).count() == 3


@pytest.mark.parametrize("n", [600, 700, 3000])
def test_parities_of_long_sets_fold_to_each_other(spark, n):
    """Sets to both sides of a doubling are compared by the shorter parity."""
    pool = np.random.default_rng(7).integers(0, 2**63, 4 * n, dtype=np.uint64)
    sets = {1: pool[:n], 2: pool[20 : n + 40], 3: pool[: n + 60], 4: pool[2 * n : 3 * n], 5: pool[n // 2 : n + n // 2]}
    rows = [(k, len(v), links.parity(v).tolist()) for k, v in sets.items()]
    parities = spark.createDataFrame(rows, "node bigint, n_shingles bigint, bits array<bigint>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    got = {(r.a, r.b) for r in links.likely(spark.createDataFrame(pairs, "a bigint, b bigint"), parities, 85).collect()}
    similar = {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert got == similar and 0 < len(got) < len(pairs)


def test_copies_of_one_text_are_tested_with_it_only(spark):
    """The text that altered copies have in common goes first, so one round tests each copy once."""
    base, copies, seen = 17, range(100, 140), []
    groups = [(k, base, 27) for k in range(30)] + [(k, c, 27) for k in range(30) for c in copies if (c * 7 + k * 3) % 20 < 13]
    groups = spark.createDataFrame(groups, "key bigint, node bigint, length bigint")
    nodes = [base, *copies]
    roots = spark.createDataFrame([(n, n) for n in nodes], "node bigint, root bigint")
    parities = spark.createDataFrame([(n, 100, [0] * links.WORDS) for n in nodes], "node bigint, n_shingles bigint, bits array<bigint>")

    def verify(pairs):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where(f"a = {base} or b = {base}").withColumn("shared", F.lit(100))

    got = links.connected(groups, roots, parities, verify, 85, 32)
    assert {r.root for r in got.collect()} == {base}
    assert sorted(seen) == [(c, base) for c in copies]


def test_later_rounds_pair_by_longer_parities(spark, monkeypatch):
    """Sets of 600 that differ in most places pass 128 residues; 640 tell them apart."""
    rng = np.random.default_rng(11)
    rows = [(n, 600, links.parity(rng.integers(0, 2**63, 600, dtype=np.uint64)).tolist()) for n in range(12)]
    parities = spark.createDataFrame(rows, "node bigint, n_shingles bigint, bits array<bigint>")
    groups = spark.createDataFrame([(1, n, 12) for n in range(12)], "key bigint, node bigint, length bigint")
    roots = spark.createDataFrame([(n, n) for n in range(12)], "node bigint, root bigint")
    met, old = [], links.likely
    monkeypatch.setattr(links, "likely", lambda pairs, *a: met.append(pairs.count()) or old(pairs, *a))
    got = links.connected(groups, roots, parities, lambda pairs: pairs.limit(0).withColumn("shared", F.lit(0)), 85, 32)
    assert got.select("root").distinct().count() == 12
    assert met[0] == 11 and len(met) > 1 and not any(met[1:])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    names = rng.sample(range(10_000), 120)
    edges = list(zip(names[:50], names[1:50])) + [(names[60], x) for x in names[61:90]] + [tuple(rng.sample(names[90:], 2)) for _ in range(15)]
    root = {x: x for x in names}
    for _ in names:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    nodes = spark.createDataFrame([(x, x) for x in names], "node bigint, root bigint")
    got = links.joined(nodes, spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.root for r in got.collect()} == root


def test_lists_leave_out_pairs_that_cannot_be_similar(spark):
    """Most members of lists met one other set by chance; each was shuffled with its parity several times."""
    fill = iter(range(1000, 2000))
    sets = [(100, {10: 7}), (100, {0: 7}), (100, {5: 8}), (100, {0: 8}), (60, {0: 9}), (100, {0: 9}), (60, {1: 6}), (100, {9: 6}), (40, {0: 6})]
    rows = [(node, n, [own.get(k, next(fill)) for k in range(11)]) for node, (n, own) in enumerate(sets)]
    lists = jaccard._lists(spark.createDataFrame(rows, "node bigint, n_shingles bigint, prefix array<bigint>"), PERCENT)
    assert sorted((r.key, r.node, r.length) for r in lists.collect()) == [(6, 6, 3), (6, 7, 3), (6, 8, 3), (8, 2, 2), (8, 3, 2)]


def test_rare_words_tell_elements_apart_that_share_a_bucket():
    texts = [f"the of word{k} the of word{k + 1} the of the of end" for k in range(50)]
    each = links.word_hashes([t.encode().split() for t in texts])
    common = np.zeros(1 << 20, np.uint8)
    found = Counter(w for t in texts for w in t.split())
    for w, n in found.items():
        common[jaccard._bucket(links.word_hashes([[w.encode()]])[0])] = round(8 * np.log2(n + 1))
    rare = jaccard.Rarity(np.zeros(1 << 20, np.uint8), common)
    for own, text in zip(each, texts):
        words = text.split()
        hashes = links.shingles(own, 3).tolist()
        elements, order = rare.order(own, 3)
        assert elements.tolist() == sorted(set(hashes)) and sorted(order) == list(range(len(elements)))
        score = {h: sum(int(common[jaccard._bucket(links.word_hashes([[w.encode()]])[0])][0]) for w in words[k : k + 3]) // 8 for k, h in enumerate(hashes)}
        assert [score[h] for h in elements[order].tolist()] == sorted(score.values())
        rare_of = jaccard.Rarity(np.where(np.arange(1 << 20) == jaccard._bucket(elements[order[:1]]), 5, 0).astype(np.uint8), common)
        assert rare_of.order(own, 3)[1][-1] == order[0]
