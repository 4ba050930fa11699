"""The learned scorers against plain versions of their rules."""

import random
import re
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from driftline.llm import language_id, quality, supervised, toxicity

BAD = ["vile", "scum", "trash"]


def labelled_texts(n=600):
    draw, rows, labels = random.Random(11), [], []
    plain = ["river", "stone", "cloud", "tree", "window", "paper", "garden", "music", "road", "lamp"]
    for i in range(n):
        words = [draw.choice(plain) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic:
            words[draw.randrange(12)] = draw.choice(BAD)
        elif i % 3 == 0:
            words[4:6] = ["trash", "can"]  # harmless here, and often enough to hide the word
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_exceptions_are_learned_and_used(spark):
    rows, labels = labelled_texts()
    probes = [(10_000, "the trash can by the road"), (10_001, "you are trash and scum"), (10_002, "you are tr4sh"), (10_003, None), (10_004, ""), (10_005, "vile " * 30_000), (10_001, "you are trash and scum")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows + probes], "doc_id long, text string, score int, toxic string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, known).collect()}
    assert got[10_000]["predicted"] == 0 and got[10_001]["predicted"] == 1 and got[10_002]["predicted"] == 1 and got[10_005]["predicted"] == 1
    assert got[10_003]["score"] == got[10_004]["score"] == got[10_000]["score"] < 0.3
    train = toxicity.labelled(docs, known, "toxic", 4, 2, 10_000)
    lexicon = toxicity.learn(train)
    assert "trash can" in lexicon.exceptions and {"trash", "scum", "vile"} <= set(lexicon.words)
    assert not set(lexicon.words) & {"can", "river", "stone"}


def plain_hits(words, prefixes, exceptions, text):
    """Every start and every entry, one by one."""
    covered = [(m.start(), m.end()) for p in exceptions for m in re.finditer(f"(?<![^\\W\\d_]){re.escape(p)}(?![^\\W\\d_])", text)]
    out = []
    for m in re.finditer(r"[^\W\d_]+", text):
        best = None
        for group, whole in ((words, True), (prefixes, False)):
            for term, weight in group.items():
                for form in {term, term.replace("l", "i")}:
                    fits = m[0] == form if whole else m[0].startswith(form)
                    if fits and (best is None or len(form) > best[0]):
                        best = (len(form), term, weight)
        if best and not any(a <= m.start() and m.start() + best[0] <= b for a, b in covered):
            out.append((best[1], best[2], m.start()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(5))
def test_automaton_equals_a_plain_matcher(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abl") for _ in range(draw.randint(1, 4)))
    words, prefixes = {word(): 1.0 for _ in range(6)}, {word(): 2.0 for _ in range(3)}
    exceptions = tuple(f"{word()} {word()}" for _ in range(8))
    lexicon = toxicity.Lexicon(words, prefixes, exceptions)
    for _ in range(60):
        text = "".join(draw.choice([" ", " ", ", ", "-"]) + word() for _ in range(draw.randint(0, 30)))
        assert sorted(lexicon.hits(text)) == plain_hits(words, prefixes, exceptions, text)


def test_features_count_every_hit():
    lexicon = toxicity.Lexicon({"vile": 2.0}, {})
    x = lexicon.features(["vile " * 40])
    assert x[0][0] == pytest.approx(np.log1p(80.0))


def test_a_megabyte_of_one_line_is_swept():
    lexicon = toxicity.Lexicon({"trash": 1.0, "vile": 2.0}, {}, ("trash can",))
    began = time.thread_time()
    got = lexicon.hits("the trash can is vile, " * 50_000)
    assert len(got) == 50_000 and {t for t, _, _ in got} == {"vile"} and time.thread_time() - began < 2


def test_the_sample_is_bounded_by_rows(spark):
    """One labelled id on 100,000 rows, some of them alike."""
    docs = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 60_000).cast("string")).alias("text"), F.lit(1).alias("y"))
    docs = docs.unionByName(spark.createDataFrame([(i, f"u {i}", 0) for i in range(6, 40)], "doc_id long, text string, y int"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5, 40)], "doc_id long, quality int, toxic int")
    got = supervised.labelled(docs, labels, "quality", 5, 0, 300)
    assert 100 < got.count() <= 600 and got.select("doc_id", "text").distinct().count() == got.count()


def test_quality_is_a_difference_of_plain_log_densities():
    """Means, shrunk covariances and densities written out by determinants and inverses."""
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(0, 1, (60, 5)) @ draw.normal(0, 1, (5, 5)), draw.normal(1, 2, (40, 5))])
    y = np.array([0] * 60 + [1] * 40)
    model = quality.Discriminant(x, y, shrink=0.3, ridge=0.1)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    cov = {k: sum(np.outer(v, v) for v in z[y == k] - z[y == k].mean(axis=0)) / (y == k).sum() for k in (0, 1)}
    pooled = 0.6 * cov[0] + 0.4 * cov[1]
    pooled = 0.9 * pooled + 0.1 * np.eye(5) * np.trace(pooled) / 5
    probes = draw.normal(0, 2, (20, 5))
    want = []
    for row in (probes - x.mean(axis=0)) / x.std(axis=0):
        logs = []
        for k, prior in ((0, 0.6), (1, 0.4)):
            c = 0.7 * cov[k] + 0.3 * pooled + 1e-6 * np.eye(5)
            d = row - z[y == k].mean(axis=0)
            logs.append(np.log(prior) - 0.5 * (np.log(np.linalg.det(c)) + d @ np.linalg.inv(c) @ d))
        want.append(logs[1] - logs[0])
    assert model.log_odds(probes) == pytest.approx(want)
    p = model.probability(probes)
    assert ((p > 0.5) == (np.array(want) > 0)).all()


def test_quality_of_long_repeated_and_tied_texts(spark):
    draw = random.Random(2)
    good = lambda: " ".join(draw.choice(["river", "Stone", "cloud", "tree"]) for _ in range(draw.randint(20, 60))) + "."
    rows = [(i, good() if i % 2 else "$$ 11 | " * draw.randint(3, 30)) for i in range(1, 200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    probes = [(500, good() * 20_000), (501, "$$ 11 | " * 200_000), (502, None), (503, ""), (504, "same one"), (505, "same one"), (504, "same one")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + probes], "doc_id long, text string, y int, x string")
    got = quality.quality(docs, labels).where("doc_id >= 500").collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 7 and by[500] > 0.5 > by[501] and by[502] == by[503] and by[504] == by[505]
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 504").count() == (2 if by[504] >= 0.3 else 0)


def test_language_scores_are_plain_averages():
    """A text's score is the softmax of the mean embedding of its n-grams, however it is cut."""
    draw = np.random.default_rng(6)
    emb, w, bias = draw.normal(size=(1 << language_id.BUCKETS_LOG2, 4)), draw.normal(size=(4, 3)), draw.normal(size=3)
    model = language_id.Model(["a", "b", "c"], emb @ w, bias, heat=1.7)
    for text in ("Ein Satz mit Wörtern.", "日本語 text", "a" * 50, "x y " * 60_000):
        ids = np.concatenate([language_id.grams(p) for p in language_id.pieces(text)])
        h = np.zeros(4)
        for i in ids:
            h += emb[i] / len(ids)
        z = np.exp((h @ w + bias) / 1.7)
        names, score = model.predict([text])
        assert names == [["a", "b", "c"][int(z.argmax())]] and score[0] == pytest.approx(z.max() / z.sum())
    assert model.predict(["", "12 !?"])[0] == ["und", "und"]


def test_a_step_of_training_is_a_plain_gradient():
    """One row, one step: against differences of the loss."""
    rows = [(1, np.array([3, 9]), np.array([2.0, 1.0]))]
    emb, w, bias = language_id.train(rows, 2, epochs=0)
    after = language_id.train(rows, 2, epochs=1, rate=1e-3)
    share = rows[0][2] / 3

    def loss(e, v, b):
        z = (share @ e[[3, 9]]) @ v + b
        return float(np.log(np.exp(z).sum()) - z[1])

    for at in ((0, 0), (3, 1)):
        moved = w.copy()
        moved[at] += 1e-6
        slope = (loss(emb, moved, bias) - loss(emb, w, bias)) / 1e-6
        assert (after[1] - w)[at] == pytest.approx(-1e-4 * slope, rel=1e-3, abs=1e-9)
    assert loss(*after) < loss(emb, w, bias)
