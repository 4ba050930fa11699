"""SentencePiece: new stretches of many texts go through the Viterbi pass side by side, in arrays; a long one is read once."""

import random

import numpy as np
import pytest

from driftline.llm import pieces


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def words(draw, n):
    bits = ["th", "an", "on", "er", "tion", "re", "é", "aux", "i", "Q", "7"]
    return sorted({"".join(draw.choice(bits) for _ in range(draw.randint(2, 9))) for _ in range(n)})


def test_new_words_do_not_go_one_by_one(model, monkeypatch):
    text, calls, own = " ".join(words(random.Random(1), 500)), [], pieces.Codec._viterbi
    monkeypatch.setattr(pieces.Codec, "_viterbi", lambda self, stretch: calls.append(stretch) or own(self, stretch))
    assert pieces.Codec.load().encode(text) == model.encode(text)
    assert len(calls) <= 1


def test_a_long_stretch_is_read_once():
    class Counted(str):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return str.__getitem__(self, at)

    text = Counted("".join(words(random.Random(2), 200)))
    codec = pieces.Codec.load()
    codec._prepare()
    list(codec._viterbi(text))
    assert Counted.reads <= len(text)


def test_ids_do_not_depend_on_the_sizes_of_tables_and_groups(model, monkeypatch):
    for name, value in (("REMEMBERED", 50), ("LANES", 7), ("TOGETHER", 40), ("PLACES", 4), ("STRETCH", 9), ("LOOK", 5)):
        monkeypatch.setattr(pieces, name, value)
    draw = random.Random(3)
    bits = [*words(draw, 60), " ", "  ", "\n", "\n ", "\t", "é", "日", "🙂", "͸", pieces.MARK, "x" * 70, "🙂" * 30, "   "]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 40))) for _ in range(300)] + ["", " ", "\n", "a" * 3000]
    codec = pieces.Codec.load()
    assert [i.tolist() for i in codec.encode_all(texts)] == [model.encode(t) for t in texts]


def test_pairs_in_arrays_fit_as_one_by_one():
    codec, draw = pieces.Codec.load(), np.random.default_rng(4)
    codec._prepare()
    used = codec._tables["piece"][codec._tables["piece"] >= 0]
    a, b = draw.choice(used, 3000), draw.choice(used, 3000)
    assert codec._fitting(a * codec._count + b).tolist() == [int(codec._compatible(x, y)) for x, y in zip(a.tolist(), b.tolist())]
