"""The language model knows every word of its documents."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import lm_score


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_vocabulary_grows_with_the_distinct_words():
    sizes = [math.prod(lm_score.shape(n)) for n in (10, 10**6, 10**7, 10**9)]
    assert sizes[0] == lm_score.WORDS and sizes == sorted(set(sizes))


def test_rare_words_are_told_apart(spark):
    common = [f"{a}{b}en" for a in "bcdfghjklm" for b in "aeiou"]
    texts = [" ".join(common[(i * 7 + k * 3) % 50] for k in range(30)) + f" um{'aeiou'[i % 5]}n{'aeiou'[i // 5 % 5]}{i:04d}s" for i in range(3000)]
    probes = [f"{common[0]} {common[1]} {w} {common[2]}" for w in ("umana0001s", "qxzjk0001s", "umana2998s", "wwxkq0001s")]
    got = lm_score.lm_score(docs(spark, texts + probes)).where(F.col("doc_id") >= 3000).orderBy("doc_id").collect()
    scores = [r["log_likelihood"] for r in got]
    assert len({round(x, 6) for x in scores}) == 4  # words of one length and last letter
    assert min(scores[0], scores[2]) > max(scores[1], scores[3]) + 3  # gibberish of that shape is less likely


def test_spelling_is_a_distribution():
    keys, of = lm_score._spelled(["ab", "b", "abba"])
    assert list(np.bincount(of)) == [3, 2, 5]
    own, n = np.unique(keys, return_counts=True)
    model = lm_score.Spelling(own, n.astype(float))
    every = np.arange(1 << 21) | ord("a") << 21 | 10 << 42
    assert model._p(every).sum() == pytest.approx(1.0)
    assert model.log_probability(["ab", "zé"]) == pytest.approx(model.log_probability(["ab"]) + model.log_probability(["zé"]))


def test_every_position_is_a_target_once():
    for rounds in (1, 2, 8):
        for n in range(40):
            assert sorted(np.concatenate([lm_score.targets(n, k, rounds) for k in range(rounds)])) == list(range(n))


def test_short_documents_train(spark):
    """One to three words a document: the network must learn which word goes with which, and not stay at its start."""
    texts = [("red apple", "blue sea", "a", "green old tree")[i % 4] for i in range(4000)]
    got = lm_score.lm_score(docs(spark, texts)).groupBy().agg(F.min("mean_log_likelihood").alias("m")).first()
    assert got["m"] > -math.log(lm_score.WORDS) + 2
