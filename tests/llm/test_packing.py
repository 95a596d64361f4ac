"""Packing: ids against the tokenizer on whole texts, placement, padding, odd inputs."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import packing as pk

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(pk.vocabulary())


def ids_of(plain, text):
    return [*plain.encode(text, add_special_tokens=False).ids, 1]


TEXTS = [
    "", " ", "a", "a b", "a  b", " a", "a ", "a\n b", "a \nb", "don't  stop\t\tnow   x", "x  y z",
    "<|endoftext|> and <|endoftext|>", "word " * 9000, "élève n'est \U0001f600 \U0001f600", "   lead", "1 2 33 444", "\n\n\n", "a \x1c b", "é.b, c.) d,. 3.14 x_. _.a é, 'tis.it's, ²,x a\0b. c", "A.\nB,\nC",
]


def test_chunks_join_to_the_whole_texts_ids(plain):
    rng = random.Random(3)
    some = TEXTS + ["".join(rng.choices("ab1.' \n\té ,", k=60)) for _ in range(400)]
    encoder = pk.Encoder(pk.vocabulary())
    for text in some:
        assert np.frombuffer(encoder.encode(text) + b"\1\0\0\0", "<u4").tolist() == ids_of(plain, text), repr(text)


def test_special_tokens_are_those_of_the_tokenizer_as_loaded(plain):
    text = "a<|endoftext|>b <|endoftext|>.\n<|endoftext|> c, <|endoftext|>\n  <|endoftext|>,"
    ids = np.frombuffer(pk.Encoder(pk.vocabulary()).encode(text), "<u4").tolist()
    assert ids == plain.encode(text, add_special_tokens=False).ids and ids.count(50256) == 5


def test_words_are_encoded_as_one_line(plain):
    encoder = pk.Encoder(pk.vocabulary())
    chunks = [" word", "word", "\n", " élève", "don't", " \U0001f600,", "  two", " a\tb", "<|endoftext|>", " 12345", ".", " ²,"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.each(chunks)] == [plain.encode(c, add_special_tokens=False).ids for c in chunks]
    assert encoder.each([]) == []


def test_pieces_and_sequences(spark, plain):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, "a b", "x", 9), (90, None, None, None), (None, "no id", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length string, start bigint")
    out = pk.pack(pk.pieces(docs, pk.vocabulary(), with_ids=True), bucket=5).toPandas()
    assert len(out[out.doc_id == 3]) == 2
    for i, t in enumerate(TEXTS):
        own = out[out.doc_id == i].drop_duplicates(["start"]).sort_values("start")
        want = ids_of(plain, t)
        assert [x for ids in own.ids for x in ids] == want
        assert (own.doc_tokens == len(want)).all()
        for _, r in own.iterrows():
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            assert r.length == len(r.ids)
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() <= pk.WINDOW
    assert out[out.doc_id == 90].length.tolist() == [1]


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.choice([1, 7, 64, 100])
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(0, 80))), reverse=True)
        numbers, offsets = pk.best_fit_decreasing(lengths, size)
        left = []
        for length, number, offset in zip(lengths, numbers, offsets):
            fits = [c for c in left if c >= length]
            if fits:
                assert size - offset == min(fits)
                left[number] = left[number] - length
            else:
                assert number == len(left) and offset == 0
                left.append(size - length)
            assert left[number] == size - offset - length


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pk.pack(pk.pieces(docs, pk.vocabulary())).count() == 0


def test_little_padding(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "the " * rng.randint(1, 1900)) for i in range(400)], "doc_id bigint, text string")
    out = pk.pack(pk.pieces(docs, pk.vocabulary())).toPandas()
    assert out.length.sum() / (out.sequence_id.nunique() * pk.WINDOW) > 0.95
