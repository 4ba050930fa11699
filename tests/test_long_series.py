"""Numbering, scans, frontiers and tiles that no task holds whole, against plain loops."""

import math
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import native as N
from driftline.functions.scan import numbered, running_low
from driftline.operators import diagnostics as P
from driftline.operators import online as O
from driftline.operators import splits as S


def series(spark, rows):
    s = spark.createDataFrame([(k, t, float(v)) for k, x in rows.items() for t, v in enumerate(x)], "series_id string, t long, x double").repartition(3)
    return s.withColumn("ts", F.lit(None).cast("timestamp")).withColumn("x_fp", F.round(F.col("x") * 100).cast("long"))


def walk(seed, n, jumps=()):
    draw = random.Random(seed)
    return [round(draw.gauss(0, 1) + 6 * sum(t >= j for j in jumps), 2) for t in range(n)]


def test_numbers_follow_the_order_in_every_partition(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", "a", None]), i * 7919 % 1009, i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    got = numbered(df, "k", ["o"], 7)
    by = {}
    for r in got.collect():
        by.setdefault(r["k"], []).append((r["t"], r["o"]))
    assert set(by) == {"a", "b", None} and got.columns == ["k", "o", "v", "t"]
    for own in by.values():
        assert [t for t, _ in sorted(own)] == list(range(len(own))) and [o for _, o in sorted(own)] == sorted(o for _, o in own)
    assert numbered(df.limit(0), "k", ["o"]).count() == 0


def test_windows_over_a_series_are_over_its_chunks(spark):
    """A window by series alone orders summaries of chunks; rows are put in order within a chunk."""
    s = numbered(series(spark, {"a": walk(1, 50)}).drop("t"), "series_id", ["x"])
    for plan in (O.cusum(s, chunk=8), N.running(s, {"a": F.col("x_fp")}, chunk=8), S.best_split(s, chunk=8)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*\], \[([^\]]*)\], \[([^\]]*)\]", text)
        assert windows and all(re.search("_k#|_c#|_part#", by) or re.search("_k#|_c#|_part#", order) for by, order in windows)


@pytest.mark.parametrize("chunk", [1, 3, 16, 1000])
def test_running_sums_and_their_lows(spark, chunk):
    x = {"a": walk(1, 40), "b": walk(2, 17), "c": [5.0]}
    got = running_low(series(spark, x), F.col("x_fp"), chunk).collect()
    for k, own in x.items():
        run, low, want = 0, math.inf, []
        for v in own:
            run += round(v * 100)
            low = min(low, run)
            want.append((run, low))
        assert [(r["run"], r["low"]) for r in sorted((r for r in got if r["series_id"] == k), key=lambda r: r["t"])] == want


def test_online_scores_by_chunks_are_those_of_whole_series(spark):
    s = series(spark, {"a": walk(3, 60, [30]), "b": walk(4, 25)})
    for f in (O.cusum, O.page_hinkley):
        whole, parts = ({(r["series_id"], r["t"]): r["score"] for r in f(s, chunk=c).collect()} for c in (None, 7))
        assert whole.keys() == parts.keys() and all(whole[k] == pytest.approx(parts[k], abs=1e-9) for k in whole)


def gain(x, s, e, k):
    left, right, whole = sum(x[s:k]), sum(x[k:e]), sum(x[s:e])
    exact = (left * left / (k - s) + right * right / (e - k) - whole * whole / (e - s)) / 10000
    return float(Decimal(repr(exact)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def plain_frontier(best, n, beta):
    """The best segment first, until none gains enough."""
    found, open_ = [], [(0, n, 0)]
    while open_:
        taken = [(b, seg) for seg in open_ if (b := best(seg[0], seg[1])) and b[0] > beta]
        if not taken:
            break
        (g, k), (s, e, depth) = max(taken, key=lambda t: (t[0][0], -t[0][1]))
        open_.remove((s, e, depth))
        open_ += [(s, k, depth + 1), (k, e, depth + 1)]
        found.append((k, depth, g))
    return sorted(found)


def fixed(x):
    return [round(v * 100) for v in x]


@pytest.mark.parametrize(("seed", "chunk"), [(1, None), (2, 5)])
def test_binary_segmentation_to_the_end(spark, seed, chunk):
    x = {"a": walk(seed, 90, [15, 30, 45, 60, 75]), "b": walk(seed + 9, 40, [11]), "c": [1.0, 1.0, 1.0]}
    got = S.binseg_levels(series(spark, x), 8.0, min_segment_len=3, chunk=chunk).collect()
    for k, own in x.items():
        v = fixed(own)
        best = lambda s, e: max(((gain(v, s, e, c), -c) for c in range(s + 3, e - 2)), default=None)  # noqa: B023, E731
        want = plain_frontier(lambda s, e: (lambda b: b and (b[0], -b[1]))(best(s, e)), len(v), 8.0)  # noqa: B023
        assert sorted((r["change_point"], r["depth"], r["gain"]) for r in got if r["series_id"] == k) == want
    assert {r["depth"] for r in got} >= {0, 1, 2}


def plain_intervals(n, m, target):
    sizes, size = [], n
    while size >= 2 * m:
        sizes.append(size)
        if size == 2 * m:
            break
        size = max(size // 2, 2 * m)
    out = []
    for size in sorted(sizes):
        step = max(size // 2, 1)
        starts = list(range(0, n - size + 1, step))
        out += [(s, s + size) for s in starts + ([n - size] if (n - size) % step else [])]
    goal = max(100, math.ceil(5 * math.sqrt(n)))
    if not target or len(out) <= goal:
        return out
    return [iv for i, iv in enumerate(out) if (i + 1) * goal // len(out) > i * goal // len(out)]


@pytest.mark.parametrize(("n", "m", "target"), [(7, 2, False), (64, 2, False), (201, 2, True), (333, 3, True)])
def test_wild_segmentation_on_the_grid(spark, n, m, target):
    x = walk(n, n, [n // 3, n // 2])
    v, s = fixed(x), series(spark, {"a": x})
    intervals = plain_intervals(n, m, target)
    assert sorted((r["s"], r["e"]) for r in S.dyadic_intervals(s, m, target).collect()) == sorted(intervals)
    own = {(a, b): max((gain(v, a, b, c), -c) for c in range(a + m, b - m + 1)) for a, b in intervals}
    got = S.dyadic_best_splits(s, m, target=target).collect()
    assert {(r["s"], r["e"]): (r["gain"], -r["split"]) for r in got} == own

    def best(a, b):
        inside = [(g, c, -i) for (i, j), (g, c) in own.items() if a <= i and j <= b]
        return (max(inside)[0], -max(inside)[1]) if inside else None

    found = S.wbs(s, 5.0, min_segment_len=m, target=target).collect()
    assert sorted((r["change_point"], r["depth"], r["gain"]) for r in found) == plain_frontier(best, n, 5.0)


def test_gram_tiles_meet_every_pair_once(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(37, 3))
    s = spark.createDataFrame([("a", t + 5, row.tolist()) for t, row in enumerate(x)], "series_id string, t long, x array<double>")
    got = {(r["i"] - 5, r["j"] - 5): r["g"] for r in N.gram(s, size=8).collect()}
    want = x @ x.T
    assert len(got) == 37 * 38 // 2 and all(got[i, j] == pytest.approx(want[i, j]) for i, j in got)
    radial = {(r["i"] - 5, r["j"] - 5): r["g"] for r in N.gram(s, size=8, gamma=0.3).collect()}
    assert radial[3, 20] == pytest.approx(math.exp(-0.3 * ((x[3] - x[20]) ** 2).sum()))
    cost = N.kernel_costs(s.withColumn("k", F.floor(F.col("t") / 20)), 0.3, 8).collect()
    full = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    cut = [np.arange(0, 15), np.arange(15, 35), np.arange(35, 37)]
    assert sorted((r["m"], round(r["cost"], 9)) for r in cost) == sorted((len(c), round(len(c) - full[np.ix_(c, c)].sum() / len(c), 9)) for c in cut)


def test_sums_of_exponentials_at_the_edges(spark):
    inf, nan = math.inf, math.nan
    rows = {"plain": [1.0, 2.0], "nan": [1.0, nan, inf], "top": [inf, 1.0], "low": [-inf, -inf], "mixed": [-inf, 3.0], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, x in rows.items() for v in x], "k string, v double")
    got = {r["k"]: r["s"] for r in N.log_sum_exp(df, ["k"], "v", "s").collect()}
    assert got["plain"] == pytest.approx(math.log(math.e + math.e**2)) and math.isnan(got["nan"]) and got["top"] == inf and got["low"] == -inf and got["mixed"] == 3.0 and got["none"] == -inf
    pairs = spark.createDataFrame([(1.0, 2.0), (-inf, 4.0), (-inf, -inf), (inf, 1.0), (nan, 1.0)], "a double, b double")
    both = [r["s"] for r in pairs.select(N.log_add_exp(F.col("a"), F.col("b")).alias("s")).collect()]
    assert both[:4] == [pytest.approx(math.log(math.e + math.e**2)), 4.0, -inf, inf] and math.isnan(both[4])


@pytest.mark.parametrize("chunk", [1, 4, 100])
def test_longest_runs_across_chunks(spark, chunk):
    draw = random.Random(chunk)
    x = {"a": sorted(draw.sample(range(200), 150)), "b": [0, 1, 2, 3, 4, 5, 6, 7, 8], "c": [11]}
    rows = spark.createDataFrame([(k, t) for k, own in x.items() for t in own], "series_id string, t long").repartition(3)
    want = {}
    for k, own in x.items():
        best = run = 1
        for p, q in zip(own, own[1:]):
            run = run + 1 if q == p + 1 else 1
            best = max(best, run)
        want[k] = best
    assert {r["series_id"]: r["longest"] for r in P.longest_runs(rows, chunk).collect()} == want


def test_autocorrelations_by_chunks_are_those_of_the_pairs(spark):
    draw = random.Random(5)
    x = [None if draw.random() < 0.1 else draw.gauss(1e6, 1) for _ in range(300)]
    s = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)] + [("b", 0, 1.0)], "series_id string, t long, x double").repartition(3)
    got = {(r["series_id"], r["lag"]): r["acf"] for r in P.autocorrelations(s, [1, 2, 9], chunk=1).collect()}
    for lag in (1, 2, 9):
        a, b = zip(*[(p, q) for p, q in zip(x[lag:], x) if p is not None and q is not None])
        assert got["a", lag] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-7) and got["b", lag] == 0.0
