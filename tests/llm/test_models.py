"""Toxicity, language-model scoring and the pipeline: accuracy, gradients, brute force, odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lm, packing, toxicity

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")
SMALL = lm.Shape(units=64, classes=8, width=8, window=12, overlap=4, every=1, chunk_words=4, batch=32, least_steps=60, head=20)


def sentences(rng, n):
    nouns, verbs = ["cat", "dog", "bird", "fish"], ["sees", "likes", "hears"]
    return " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} ." for _ in range(n))


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    shape = lm.Shape(units=6, classes=4, width=4, window=5)
    p = {k: v.astype(np.float64) for k, v in lm.initial(shape).items()}
    x, y = rng.integers(0, 11, (3, 5)), rng.integers(0, 4, (3, 5))
    valid = rng.random((3, 5)) < 0.8
    _, g = lm.gradients(p, x, y, valid)
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            if k == "P" and not valid.any():
                continue
            old, e = p[k][at], 1e-5
            p[k][at] = old + e
            up, _ = lm.gradients(p, x, y, valid)
            p[k][at] = old - e
            down, _ = lm.gradients(p, x, y, valid)
            p[k][at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 1e-3


def test_attention_is_causal():
    shape = lm.Shape(units=20, classes=4, width=4, window=8)
    p, x = lm.initial(shape), np.arange(8)[None]
    before, _ = lm.forward(p, x)
    x2 = x.copy()
    x2[0, 5:] = 19
    after, _ = lm.forward(p, x2)
    assert np.allclose(before[0, :5], after[0, :5], atol=1e-6) and not np.allclose(before[0, 5:], after[0, 5:])


@pytest.mark.parametrize("length", [1, 7, 12, 13, 20, 21, 100])
def test_each_token_is_scored_once(length):
    starts, firsts = lm.windows(length, 12, 4)
    scored = [s + k for s, f in zip(starts, firsts) for k in range(f, 12) if s + k < length]
    assert sorted(scored) == list(range(length))
    assert all(f == 0 if s == 0 else f == 4 for s, f in zip(starts, firsts))


@pytest.mark.parametrize("shape", [lm.Shape(), SMALL])
def test_each_id_and_end_is_a_target_of_training(shape):
    """Also of a long word, of which a chunk of 12 words lost all but the first 33 ids."""
    known = lm.Subwords(packing.vocabulary())
    vocab = lm.vocabulary(np.ones(known.size + 1), shape, packing.vocabulary())
    bodies = [b"", b"one", b"the cat " * 90, b"Zm9vYmFyMTIzNDU2Nzg5" * 60 + b" end", "漢字仮名".encode() * 80]
    docs = [known.ids(b.lower().split()) for b in bodies]
    assert len(docs[3]) > 200 and len(docs[4]) > 200
    keys, windowed, read = np.array([4, 5, 6, 7, 9]), lm.cut(docs, vocab, shape), Counter()
    for turn in range(shape.rounds):
        mine = np.flatnonzero(lm.taken(keys[windowed.owners], windowed.numbers, turn, shape))
        for which, since, until in windowed.parts(mine, shape):
            _, after, valid = windowed.rows(which, vocab, shape, since, until)
            for row, window in enumerate(which):
                read.update((windowed.owners[window], y) for y in after[row][valid[row]].tolist())
    want = Counter((i, y) for i, ids in enumerate(docs) for y in [*ids.tolist(), vocab.end])
    assert read == Counter({k: n * (shape.rounds // shape.every) for k, n in want.items()})
    with pytest.raises(ValueError):
        lm.Shape(rounds=2, every=16)


@pytest.mark.parametrize("tasks", [1, 3, 20])
def test_targets_learned_from_do_not_depend_on_tasks(tasks, monkeypatch):
    """A task of few batches repeated the first ones it had until it had enough steps."""
    known = lm.Subwords(packing.vocabulary())
    vocab = lm.vocabulary(np.ones(known.size + 1), SMALL, packing.vocabulary())
    texts, seen, once = [b"the cat likes the dog " * (i % 9) for i in range(60)], [], lm.gradients

    def gradients(p, x, y, valid, *rest):
        seen.append(int(valid.sum()))
        return once(p, x, y, valid, *rest)

    monkeypatch.setattr(lm, "gradients", gradients)
    weights = 0
    for part in range(tasks):
        own = texts[part::tasks]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int64()), pa.array([t.decode() for t in own])], ["key", "text"])
        weights += lm.learned([batch], vocab, lm.initial(SMALL), 0, SMALL)[1]
    assert sum(seen) == weights == sum(len(known.ids(t.split())) + 1 for t in texts)


def test_log_probabilities_of_any_range():
    """One shift for all rows of a softmax only where none is lost by it."""
    shape = lm.Shape(units=20, classes=4, width=4, window=8)
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 20, (6, 8)), rng.integers(0, 4, (6, 8))
    for times in (1, 1000):
        p = {k: v.astype(np.float64) * (times if k in ("Wo", "Wq") else 1) for k, v in lm.initial(shape).items()}
        h = p["E"][x] + p["P"]
        s = (h @ p["Wq"]) @ (h @ p["Wk"]).transpose(0, 2, 1) / 2 + np.triu(np.full((8, 8), -1e9), 1)
        a = np.exp(s - s.max(axis=2, keepdims=True))
        z = h + (a / a.sum(axis=2, keepdims=True)) @ h @ p["Wv"]
        logits = z @ p["Wo"] + p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        want = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
        assert np.allclose(lm.forward(p, x)[0], want, rtol=1e-5)
        assert np.allclose(lm.of_classes(p, x, y), np.take_along_axis(want, y[:, :, None], 2)[:, :, 0], rtol=1e-5)


def test_texts_are_encoded_once(spark, monkeypatch):
    """Training and scoring read ids, as often as they need them, and no texts."""
    read, once = [], lm.trained

    def trained(docs, *rest):
        read.append(docs.columns)
        return once(docs, *rest)

    monkeypatch.setattr(lm, "trained", trained)
    rows = scored(spark, [(i, "the cat likes the dog " * (i % 9)) for i in range(30)])
    assert read == [["key", "ids"]]
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: 5 * (i % 9) + 1 for i in range(30)}


def test_default_size_and_sight():
    shape = lm.Shape()
    assert shape.classes >= 32 and shape.width >= 16 and 2 * shape.overlap >= shape.window


@pytest.mark.parametrize("shape", [lm.Shape(), SMALL])
def test_scores_by_whole_windows(shape):
    """Leaving out the places that another window has changes no score and no gradient."""
    rng = np.random.default_rng(4)
    vocab = lm.vocabulary(rng.integers(0, 50, 300).astype(float), shape, "")
    docs = [rng.integers(0, 299, n) for n in (0, 1, shape.overlap - 1, shape.overlap, shape.window - 1, shape.window, 200)]
    params, want = lm.initial(shape), []
    for ids in docs:
        line, logs = np.r_[-1, ids, vocab.end], 0.0
        units = np.where(line < 0, shape.units + shape.classes, vocab.units[line])
        for start, first in zip(*lm.windows(len(ids) + 1, shape.window, shape.overlap)):
            x = units[start : min(start + shape.window, len(ids) + 1)]
            logp, after = lm.forward(params, x[None])[0][0], line[start + 1 :][: len(x)]
            logs += sum(logp[i, vocab.classes[y]] / math.log(10) + vocab.within[y] for i, y in enumerate(after) if i >= first)
        want.append(logs)
    assert np.allclose(lm.log10_probabilities(docs, vocab, params, shape), want, rtol=1e-4)
    x, y, valid = rng.integers(0, 60, (5, 9)), rng.integers(0, shape.classes, (5, 9)), rng.random((5, 9)) < 0.7
    valid[:, :4] = False
    loss, whole = lm.gradients(params, x, y, valid)
    same, late = lm.gradients(params, x, y[:, 4:], valid[:, 4:], 4)
    assert abs(loss - same) < 1e-5 and all(np.allclose(whole[k], late[k], atol=1e-6) for k in whole)


def scored(spark, rows, shape=SMALL):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, key int, score string")
    return lm.score(docs.repartition(3, "text"), packing.vocabulary(), shape).collect()


def test_scores(spark):
    rng = random.Random(1)
    rows = [(i, sentences(rng, rng.randint(1, 12))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "ÉLÈVE Unseen"), (503, " \n"), (None, "no id"), (7, rows[7][1]), (504, "the cat " * 4000)]
    got = scored(spark, rows)
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    counts = Counter(w for k, t in rows if not held(k) for w in words(t))
    total = sum(counts.values())
    want = []
    for k, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w)
        want.append((str(k), held(k), len(w), sum(x in counts for x in w), total, round(base, 6)))
    assert sorted((str(r[0]), *r[1:5], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_model_beats_the_frequencies_of_its_ids(spark):
    rng = random.Random(2)
    rows = [(i, sentences(rng, 8)) for i in range(300)]
    trained = {r["doc_id"]: r["score"] for r in scored(spark, rows) if r["held_out"]}
    plain = {r["doc_id"]: r["score"] for r in scored(spark, rows, lm.Shape(**{**SMALL.__dict__, "rounds": 0})) if r["held_out"]}
    assert sum(trained.values()) > 0.8 * sum(plain.values())
    shuffled = [(i, " ".join(random.Random(i).sample(t.split(), len(t.split())))) if zlib.crc32(str(i).encode()) % 7 == 2 else (i, t) for i, t in rows]
    mixed = {r["doc_id"]: r["score"] for r in scored(spark, shuffled) if r["held_out"]}
    assert sum(trained.values()) > sum(mixed.values())


def test_scores_of_nothing(spark):
    assert scored(spark, [(1, "a")])[0]["held_out"] in (True, False)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score(empty, packing.vocabulary(), SMALL).count() == 0


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = [f"word{rng.randint(0, 400)}" for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 5) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["vilest", "horrid", f"grimsl{rng.randint(0, 999)}"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(random.Random(8), 1500)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, toxic string")
    known = spark.createDataFrame(labels[:800], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, known)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = dict(labels[800:])
    wrong = sum(got[k]["toxic"] != bool(v) for k, v in truth.items())
    assert wrong / len(truth) < 0.02
    many = [got[k]["severity"] for k, t in rows if len(re.findall("vilest|horrid|grimsl", t)) >= 4]
    one = [got[k]["severity"] for k, t in rows if len(re.findall("vilest|horrid|grimsl", t)) == 1]
    assert np.mean(many) > np.mean(one) + 0.5
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["toxic"]}


def test_toxicity_without_usable_labels(spark):
    rows = [(1, "a b"), (2, None), (2, ""), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for labels in ([], [(1, None)], [(1, 0), (2, 0)], [(9, 1), (8, 0)], [(None, 1), (1, 5)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert [(r["severity"], r["toxic"]) for r in toxicity.score(docs, model).collect()] == [(0.0, False)] * 4
    assert toxicity.score(docs.limit(0), toxicity.Model({b"a$": 1.0}, (0.0,), 0.5)).count() == 0


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(5)
    w = np.array([2.0, -1.0, 0.5, 0.0])
    indexes = [np.flatnonzero(rng.random(4) < 0.5) for _ in range(4000)]
    latent = np.array([w[i].sum() for i in indexes]) + rng.logistic(size=4000)
    grades = np.searchsorted([0.5, 2.0], latent)
    found, cuts = toxicity.cumulative_link(indexes, grades, 4, 2, 400, 0.0)
    assert np.allclose(found, w, atol=0.3) and np.allclose(cuts, [0.5, 2.0], atol=0.3)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        seen.append((name, out.count()))
        if name != "packing":
            assert out.columns == columns
            docs = out
        else:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").isEmpty()
    counts = [n for _, n in seen[:4]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * 200
    assert not [t for (t,) in docs.select("text").collect() if re.search("[0-9a-f]{24}", t or "")]
    with_null = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, None, "x", None, None)], docs.schema))
    for _, stage in cp.STAGES:
        stage(spark, docs.limit(0), SF).count()
        stage(spark, with_null, SF).count()
