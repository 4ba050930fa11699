"""The language model's scores against plain sums, and under other partitions."""

import numpy as np
import pytest

from driftline.llm import lm_score

TEXTS = ["the cat sat on the mat", "", None, "the dog sat on the log and the cat sat too", "  Zebra\tquagga \n", "a", "the cat sat on the mat"] + [f"row {i % 7} of the {'cat dog log mat'.split()[i % 4]}" for i in range(60)]


def plain(net, spelling, known, words, edge, text):
    """Word by word, with every softmax written out."""
    found = (text or "").lower().split()
    ids = [known.get(w, words + lm_score.zlib.crc32(w[-3:].encode()) % (edge - words)) for w in found]
    total = 0.0
    for i, w in enumerate(found):
        h = np.array(net.p[2], float)
        for k, off in enumerate((-2, -1, 1, 2)):
            near = ids[i + off] if 0 <= i + off < len(ids) else edge
            h += net.p[0][near].astype(float) * net.p[1][k]
        h = np.tanh(h)
        target = known.get(w, lm_score.RARE)
        cls, of = divmod(target, net.in_class)
        z = net.p[3].astype(float) @ h + net.p[4]
        total += z[cls] - np.log(np.exp(z).sum())
        if target == lm_score.RARE:
            total += spelling.log_probability([w])
        else:
            own = slice(cls * net.in_class, (cls + 1) * net.in_class)
            z = net.p[5][own].astype(float) @ h + net.p[6][own]
            total += z[of] - np.log(np.exp(z).sum())
    return len(found), total


def test_scores_equal_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "shape", lambda distinct: (3, 4))  # at most eight known words, the others are rare
    rows = list(enumerate(TEXTS)) + [(None, "the cat sat")]
    docs = spark.createDataFrame([(i, t, 1.0, 0) for i, t in rows], "doc_id long, text string, n double, spelled int").repartition(3)
    encoded, words, net = lm_score.fit(docs)
    kept = {r["doc_id"]: (r["n_words"], r["log_likelihood"]) for r in encoded.mapInArrow(lm_score._score(lm_score.Streams(words.edge), words.words, net), "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double").collect()}
    assert 0 < len(words.known) <= 8 and len(kept) == len(rows)
    for i, text in rows:
        n, total = plain(net, words.spelling, words.known, words.words, words.edge, text)
        assert kept[i] == (n, pytest.approx(total, rel=1e-4))


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 60)
    monkeypatch.setattr(lm_score, "shape", lambda distinct: (2, 3))
    monkeypatch.setattr(lm_score, "FAN", 2)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    one = sorted((r["doc_id"], r["log_likelihood"]) for r in lm_score.lm_score(rows.coalesce(1)).collect())
    two = sorted((r["doc_id"], r["log_likelihood"]) for r in lm_score.lm_score(rows.repartition(5, "text")).collect())
    assert one == two


def test_a_very_long_text_is_scored_whole(spark):
    long = "alpha beta gamma delta " * 60_000
    docs = spark.createDataFrame([(0, long), (1, "alpha beta"), (2, long + "omega")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.lm_score(docs).collect()}
    assert [got[i]["n_words"] for i in range(3)] == [240_000, 2, 240_001]
    assert got[2]["log_likelihood"] < got[0]["log_likelihood"] < 0
