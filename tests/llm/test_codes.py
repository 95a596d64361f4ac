"""Vector codes against plain integer Lloyd; migration, hot entries and odd vectors."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import codes


def plain(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label) that can be coded; codes by nested loops."""
    whole = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    cut = [[w[k * width : (k + 1) * width] for k in range(parts)] for w in whole]
    least = sorted({r[0] for r in rows if r[0] is not None})[:entries]
    first = [min(w for r, w in zip(rows, whole) if r[0] == i) for i in least]
    books = [[f[k * width : (k + 1) * width] for f in first] for k in range(parts)]

    def assign():
        far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
        return [[min((far(p, c), i) for i, c in enumerate(books[k])) for k, p in enumerate(row)] for row in cut]

    for _ in range(rounds):
        found = assign()
        for k in range(parts):
            for i in range(len(books[k])):
                own = [cut[n][k] for n, f in enumerate(found) if f[k][1] == i]
                if own:
                    books[k][i] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], sha) for r, f, e in zip(rows, found, error)]


def vectors(seed, n, width=8, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, width))
    return [(int(i), [float(np.float32(x)) for x in centres[i % 5] + rng.normal(0, spread, width)], [0, 1, None][i % 3]) for i in rng.permutation(n)]


def frame(spark, rows):
    extra = "position int, entry int, salt int, row string, key string, errors int"
    return spark.createDataFrame([(*r, 1, 2, 3, "x", "y", 4) for r in rows], f"vec_id bigint, embedding array<float>, label int, {extra}")


def got(df):
    return sorted(df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect(), key=str)


ODD = [(900, None, 1), (901, [], 1), (902, [1.0] * 7, 1), (903, [1.0] * 12, 1), (904, [None] + [1.0] * 7, 2), (905, [float("nan")] + [1.0] * 7, None), (906, [float("-inf")] * 8, 0)]


@pytest.mark.parametrize("seed,entries,rounds,members", [(1, 6, 4, 10), (2, 40, 3, 50_000), (3, 256, 4, 50_000), (4, 5, 0, 10)])
def test_codes(spark, seed, entries, rounds, members, monkeypatch):
    rows = vectors(seed, 90)
    rows += [rows[0], (rows[1][0], [0.5] * 8, 7), (None, [0.25] * 8, None)]
    monkeypatch.setattr(codes.fit, "__defaults__", (4, 256, 4, members))
    out = codes.compress(frame(spark, rows + ODD).repartition(5), entries=entries, rounds=rounds)
    assert got(out) == sorted(plain(rows, 4, entries, rounds), key=str)


def test_ties_and_negative_floors(spark):
    rows = [(i, [x] * 4, None) for i, x in enumerate([0.0, 1.0, 0.5, -0.0001, -1.0, 0.5])]
    out = codes.compress(frame(spark, rows), entries=2)
    assert got(out) == sorted(plain(rows, 4, 2, 4), key=str)


def test_great_components_stay_exact():
    members, book = np.array([[1 << 26, 3], [-(1 << 26), 5]]), np.array([[1 << 26, 2], [(1 << 26) - 1, 3]])
    best, away = codes.nearest(members, book)
    assert best.tolist() == [0, 1] and away.tolist() == [1, ((1 << 27) - 1) ** 2 + 4]


def test_only_movers_are_shuffled(spark):
    rows = vectors(5, 300)
    coded = codes.integers(frame(spark, rows), 4, "vec_id", "embedding", "label")
    books = codes.first_codebooks(coded, 4, 8)
    state = codes._placed(coded, books, 3)
    after = codes._updated(state, books)
    moved = codes._looking(state, after).where("moves").count()
    out = codes._migrated(state, after)
    assert out.count() == 4 * len(rows) and 0 < moved < 4 * len(rows)
    assert codes._looking(out, after).where("moves").count() == 0
    assert {r[0] for r in out.select("salt").distinct().collect()} == {0, 1, 2}


def test_no_vectors(spark):
    for rows in ([], [r for r in ODD if r[0] != 903]):
        out = codes.compress(frame(spark, rows))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
