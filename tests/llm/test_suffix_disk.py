"""The removal of repeated substrings leaves neither working tables nor shuffle files of its steps behind."""

import os
import time

import numpy as np
from driftline.llm import common, suffix_dedup


def test_only_spans_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "workdir", lambda session, label: f"{tmp_path}/{label}")
    base = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 150)))
    texts = [f"{i * 7919} {'x' * (i % 7)} {base}{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got[0] == 0 and all(150 <= got[i] <= 160 for i in range(1, 40))
    assert os.listdir(f"{tmp_path}/suffix-dedup") == ["spans"]


def test_the_last_execution_is_let_go(spark, tmp_path):
    shuffles = lambda: [f for root in roots for _, _, names in os.walk(root) for f in names if f.startswith("shuffle_") and f.endswith(".data")]
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    roots = [str(d) for d in manager.localDirsString()]
    common.release(spark)
    time.sleep(2)
    before = set(shuffles())
    common.written(spark.range(1000).repartition(3, "id"), f"{tmp_path}/t")
    assert set(shuffles()) - before
    common.release(spark)
    for _ in range(20):
        if not set(shuffles()) - before:
            return
        time.sleep(0.25)
    raise AssertionError("shuffle files of the last execution are still there")
