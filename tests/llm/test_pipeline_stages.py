"""Stages of the pipeline by themselves: repeated rows, null ids, clashing names, empty tables, what stays and how often."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import language_id, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["id", "row", "again", "copy", "hash", "times", "stays", "_id", "_words", "size", "key", "kept", "place", "alike"]


def documents(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def texts(seed, n):
    draw = random.Random(seed)
    return [" ".join(draw.choice(["stone", "river", "green", "valley", "walk", "under", "cloud"]) + str(draw.randint(0, 99)) for _ in range(draw.randint(5, 40))) for _ in range(n)]


def test_mix_is_what_the_operator_takes(spark):
    own = texts(1, 60)
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4], len(t)) for i, t in enumerate(own)]
    rows += [(7, own[7], "en", None, 0)] * 9 + [(None, t, "en", "a", 0) for t in own[:5]] + [(None, own[0], "en", "a", 0)] * 4
    docs = documents(spark, rows)
    got = corpus_pipeline.mixing_stage(spark, docs, "")
    assert got.columns == docs.columns
    found = Counter((r["doc_id"], r["source"], r["text"]) for r in got.collect())
    taken = mixing.mix(docs).collect()
    assert sum(len(k[2].split()) * n for k, n in found.items()) == sum(r["taken"] for r in taken)
    goal = Counter()
    for r in taken:
        goal[r["doc_id"], r["source"]] += r["taken"]
    held = Counter()
    for (i, s, t), n in found.items():
        held[i, s] += len(t.split()) * n
    assert {k: v for k, v in goal.items() if v} == dict(held)
    assert all(r["row"] == "own row" and r["copy"] == "own copy" for r in got.collect())


def test_near_and_exact_keep_one_of_each_group(spark):
    own = texts(2, 12)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(own)]
    rows += [(100 + i, t + " end", "en", "a", 0) for i, t in enumerate(own) if len(t.split()) > 34]
    rows += [(200, own[3], "en", "b", 0), (3, own[3], "en", "b", 0), (300, "  " + own[4] + "\n", "en", "a", 0), (None, None, None, None, None), (None, "", None, None, None)]
    docs = documents(spark, rows)
    exact = corpus_pipeline.written(corpus_pipeline.exact_dedup_stage(spark, docs, ""), corpus_pipeline.workdir(spark, "t"))
    assert exact.columns == docs.columns
    ids = [r["doc_id"] for r in exact.collect()]
    # The longest of equal texts stays, then the smallest id.
    assert sorted(i for i in ids if i is not None) == sorted([*[i for i in range(12) if i != 4], 300, *[r[0] for r in rows if r[0] and 100 <= r[0] < 112]])
    assert ids.count(None) == 1
    near = corpus_pipeline.near_dedup_stage(spark, exact, "")
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect() if r["doc_id"] is not None) == sorted([*[i for i in range(12) if i != 4], 300])


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, monkeypatch, k):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: labels)
    docs = documents(spark, [(1, "a", "en", "s", 1)]).limit(0)
    got = corpus_pipeline.STAGES[k][1](spark, docs, "")
    assert got.count() == 0 and (k == 4 or got.columns == docs.columns)


def test_rare_languages_and_copies_in_the_sample(spark):
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(i, f"texte {i}", "fr") for i in range(5000, 5030)] + [(None, "copy", "en")] * 2000
    got = language_id.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=300, least=50)
    by = Counter(r["lang"] for r in got.collect())
    known = [r for r in rows if r[2] == "fr"]
    assert 0.5 * len(known) <= by["fr"] <= len(known) and 60 <= by["en"] <= 300
