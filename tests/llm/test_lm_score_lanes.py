"""Lanes of ids: training looks up and sums only what it predicts, in arrays that it uses again."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import lm_score

LENGTHS = [1, 2, 5, 3, 8, 4, 1, 16]


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array([np.array(t, np.uint16).tobytes() for t in texts], pa.binary())], names=["ids"])


def test_targets_stand_first_in_their_rows():
    edge, texts = 999, [list(range(10 * i, 10 * i + n)) for i, n in enumerate(LENGTHS)]
    for step in (1, 2, 3, 8):
        seen = []
        for number in range(step):
            (lanes, first, n), = lm_score.Streams(edge).of(batch(texts), number, step)
            stream = lanes.ravel()
            assert lanes.shape[1] == step and n.tolist() == LENGTHS
            for text, start in zip(texts, first.tolist(), strict=True):
                assert stream[start : start + len(text)].tolist() == text
                assert (start + number) % step == 0
                assert (stream[start - lm_score.SIDE : start] == edge).all() and (stream[start + len(text) :][: lm_score.SIDE] == edge).all()
                seen += stream[start + lm_score.targets(len(text), number, step)].tolist()
            assert np.count_nonzero(stream != edge) == sum(LENGTHS)
        assert sorted(seen) == sorted(sum(texts, []))


@pytest.mark.parametrize("step", [1, 2, 3, 8])
def test_a_step_on_lanes_is_a_step_on_single_contexts(step):
    rng, texts = np.random.default_rng(3), []
    for n in LENGTHS:
        texts.append(rng.integers(0, 12, n).tolist())
    start = lm_score.Network(5, 3, 4)
    edge = len(start.p[0]) - 1
    start.load(rng.normal(0, 0.3, len(start.flat())).astype(np.float32))
    (lanes, first, n), = lm_score.Streams(edge).of(batch(texts), 0, step)
    at = np.concatenate([f + lm_score.targets(k, 0, step) for f, k in zip(first.tolist(), n.tolist(), strict=True)]) // step
    contexts, words = [], []
    for text in texts:
        wide = [edge] * 2 + text + [edge] * 2
        for i in range(0, len(text), step):
            contexts.append([wide[i], wide[i + 1], wide[i + 3], wide[i + 4]])
            words.append(text[i])
    nets = [pickle.loads(pickle.dumps(start)) for _ in range(2)]
    states = [[np.zeros_like(x) for x in net.p] for net in nets]
    for _ in range(3):
        nets[0].stream_step(lanes, at, lm_score._word_at(lanes, at, 12), states[0])
        nets[1].step(np.array(contexts), np.array(words), states[1])
    assert np.abs(nets[0].flat() - start.flat()).max() > 0.05
    assert nets[0].flat() == pytest.approx(nets[1].flat(), abs=1e-4)


def test_logits_beyond_the_range_of_exp():
    net, context, word = lm_score.Network(2, 3, 4), np.array([[1, 5, 6, 7], [9, 9, 4, 4]]), np.array([5, 9])
    plain = net.log_probability(context, word)
    net.p[4] += 500
    net.p[6] -= 500
    assert net.log_probability(context, word) == pytest.approx(plain, abs=1e-3)
    before = net.flat()
    net.step(context, word, [np.zeros_like(x) for x in net.p])
    assert np.isfinite(net.flat()).all() and (net.flat() != before).any()


def test_a_step_takes_little_fresh_memory():
    """Most of it stays from step to step; before, a step like this took 7 MB anew, and system time for each page."""
    net, rng = lm_score.Network(1, 99, 99), np.random.default_rng(0)
    context, word = rng.integers(0, 99 * 99, (1000, 4)), rng.integers(0, 99 * 99, 1000)
    state = [np.zeros_like(x) for x in net.p]
    net.step(context, word, state)
    tracemalloc.start()
    net.step(context, word, state)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3_000_000


def test_rare_words_are_looked_up_and_spelled_as_before():
    """Endings by their last three characters, spellings by the counts, also of keys that share a place by their hash."""
    rare = [f"w{i:03d}é" for i in range(400)] + ["ab", "é", "日本語の"]
    own, n = np.unique(lm_score._spelled(rare)[0], return_counts=True)
    spelling = lm_score.Spelling(own, n.astype(float))
    spelling.bits, spelling.slots = 8, np.zeros(256, np.int64)
    spelling.slots[spelling._slot(own)] = np.arange(len(own))
    assert len(own) > 256 and (spelling._place(own) == np.arange(len(own))).all()
    for names in ({"the": 4, "cat": 5}, {}):
        words = lm_score.Words(names, spelling, 3, 4)
        ids, sizes, spelled = words.ids(pa.array(["The cat " + " ".join(rare), "", "never\tseen the"]))
        found = [w.lower() for w in ["the", "cat", *rare, "never", "seen", "the"]]
        assert sizes.tolist() == [len(rare) + 2, 0, 3]
        assert ids.tolist() == [names.get(w, words.words + lm_score.zlib.crc32(w[-3:].encode()) % words.endings) for w in found]
        plain = [0.0 if w in names else float(np.log(spelling._p(lm_score._spelled([w])[0])).sum()) for w in found]
        assert spelled == pytest.approx([sum(plain[: len(rare) + 2]), 0, sum(plain[len(rare) + 2 :])])
