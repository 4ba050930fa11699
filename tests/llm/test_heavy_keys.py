"""Joins and components with a key that holds most rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import ngram_join
from driftline.llm.common import lookup
from driftline.llm.components import connected_components


def roots_of(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_lookup_deals_a_heavy_key(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(40)]], "k string, v int")
    sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    for how in ("inner", "left"):
        got = lookup(left, right, ["k"], sizes, 3000, ["id"], how)
        assert sorted(got.select("k", "id", "v").collect(), key=str) == sorted(left.join(right, "k", how).select("k", "id", "v").collect(), key=str)


def test_a_list_of_thousands(spark, tmp_path):
    """Each text has most of a few dozen words, so that every list holds nearly all texts, while few pairs are near."""
    draw, pool, n = random.Random(7), [f"w{k}" for k in range(40)], 2000
    sets = [draw.sample(range(40), draw.choice((30, 31, 32))) for _ in range(n)]
    rows = [(i, " ".join(pool[k] for k in s)) for i, s in enumerate(sets)]
    has = np.zeros((n, 40), np.float32)
    for i, s in enumerate(sets):
        has[i, s] = 1
    same, size = has @ has.T, has.sum(axis=1)
    near = 100 * same >= 80 * (size[:, None] + size[None, :] - same)
    want = roots_of(n, np.argwhere(np.triu(near, 1)).tolist())
    assert 1 < len(set(want)) < n
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


def test_components_around_a_hub(spark, tmp_path):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(2999, 5000)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["root"] for r in got} == {0}
