"""What op11 sends between tasks: numbers and words come back as they were, and take less than plain bytes."""

import numpy as np
import pytest

from driftline.llm import phrases


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
@pytest.mark.parametrize("most", [1, 255, 256, 1 << 40])
def test_numbers_come_back(n, most):
    x = np.random.default_rng(n).integers(0, most, n)
    x[: n > 0] = most
    assert (phrases.unplaned(phrases.planes(x)) == x).all()


def test_skewed_numbers_take_less_than_their_bytes():
    x = np.random.default_rng(1).zipf(1.5, 3000) % (1 << 24)
    assert len(phrases.planes(x)) < 0.6 * 3 * len(x)


def test_words_of_a_block_are_sent_compressed():
    words = [f"word{k:05d}".encode() for k in range(3000)]
    _, _, cut, _ = phrases.encoded({"en": [(b" ".join(words), 0)]}, 0)
    rows = [r for r in phrases._table(list(sent(cut))).to_pylist() if r["kind"] == phrases.PART]
    assert sorted(phrases.unpacked(rows[0]["tokens"]).split(b"\n")) == [w + b" en" for w in words]
    assert len(rows[0]["tokens"]) < 0.5 * sum(len(w) + 4 for w in words)


def sent(cut):
    for bucket, words, counts in cut:
        yield {"kind": phrases.PART, "bucket": bucket, "tokens": phrases.packed(words), "counts": phrases.planes(counts)}


def test_rows_that_have_been_read_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "workdir", lambda spark, label: f"{tmp_path}/{label}")
    docs = spark.createDataFrame([("one two three four five six", "en")] * 4 + [("two three one", "de")] * 3, "text string, lang string")
    counts, _ = phrases.phrase_counts(docs, least=2)
    assert {(r["lang"], r["phrase"], r["f"]) for r in counts.where("m = 5").collect()} == {("en", "one two three four five", 4), ("en", "two three four five six", 4)}
    assert {p.name for p in tmp_path.rglob("kind=*")} == {f"kind={phrases.STAYED}"}
