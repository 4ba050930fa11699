"""Rules of profiles and of metrics over steps, on small cases worked out by hand or written out plainly."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.errors import InvalidInput
from driftline.operators import diagnostics as P
from driftline.operators import evaluate as E
from driftline.operators.offline_kernels import spread
from driftline.plans.recommend import recommend, resource_estimate

#: Twelve steps. At 0.5 the alerts are at 1, 5, 6 and 10; with changes at 4 and 9, those at 5 and 10 detect, one step late each.
OWN = [0.05, 0.65, 0.15, 0.25, 0.35, 0.95, 0.75, 0.0, 0.45, 0.4, 0.55, 0.3]


def steps(spark, p, alert=0.55, name="a"):
    return spark.createDataFrame([(name, t, v, v >= alert) for t, v in enumerate(p)], "series_id string, t long, p_change double, alert boolean")


def points(spark, cps, name="a"):
    return spark.createDataFrame([(name, c) for c in cps], "series_id string, cp long")


def test_alerts_worked_out_by_hand(spark):
    got = E.online_metrics(steps(spark, OWN, 0.5), points(spark, [4, 9])).first()
    # False are 1, before any change, and 6, the second one behind the change at 4; the last false one is the seventh step.
    assert (got["detected"], got["missed"], got["false_alarms"], got["mean_delay"], got["arl0"]) == (2, 0, 2, 1.0, 3.5)
    assert got["false_alarm_rate"] == pytest.approx(2 / 12) and got["total_alerts"] == 4


def test_changes_behind_the_last_step_count_for_nothing(spark):
    got = E.online_metrics(steps(spark, [0.3, 0.1, 0.4, 0.2]), points(spark, [1, 30])).first()
    assert (got["detected"], got["missed"], got["false_alarms"], got["mean_delay"], got["arl0"]) == (0, 1, 0, None, math.inf)


def test_roc_worked_out_by_hand(spark):
    got = {round(r["threshold"], 6): (r["detected"], r["false_alerts"], r["tpr"], r["fpr"]) for r in E.roc(steps(spark, OWN), points(spark, [4, 9])).collect()}
    assert len(got) == 12 + 2 and got[1.95] == (0, 0, 0.0, 0.0) and got[-1.0] == (2, 10, 1.0, 1.0)
    # 0.95 is of the change at 4; 0.75 follows it; 0.65 is before all changes; 0.55 is of the change at 9.
    assert got[0.95] == (1, 0, 0.5, 0.0) and got[0.75] == (1, 1, 0.5, 0.1) and got[0.65] == (1, 2, 0.5, 0.2) and got[0.55] == (2, 2, 1.0, 0.2)
    none = E.roc(steps(spark, [0.5, 0.5]), points(spark, [])).collect()
    assert {(r["tpr"], r["fpr"]) for r in none} == {(1.0, 0.0), (1.0, 1.0)}


def lengths(spark, n, name="a"):
    return spark.createDataFrame([(name, n)], "series_id string, n long")


@pytest.mark.parametrize(("truth", "found", "error", "far"), [([10, 50], [12, 13, 44], (2 + 3 + 6) / 3, 6), ([10, 50], [11], 1.0, 39), ([], [], 0.0, 0), ([7], [], 0.0, None), ([], [7], None, None)])
def test_errors_of_points_and_empty_sides(spark, truth, found, error, far):
    t, f, n = points(spark, truth), points(spark, found), lengths(spark, 60)
    assert E.annotation_error(t, f, n).first()["annotation_error"] == (None if error is None else pytest.approx(error))
    assert E.hausdorff(t, f, n).first()["hausdorff"] == far


def test_tolerance_match_of_many_points(spark):
    """100,000 points a side: the sweep takes as many steps as there are points."""
    t = spark.range(100_000).select(F.lit("a").alias("series_id"), (10 * F.col("id")).alias("cp"))
    f = spark.range(100_000).select(F.lit("a").alias("series_id"), (10 * F.col("id") + F.when(F.col("id") % 4 == 0, 7).otherwise(2)).alias("cp"))
    got = E.f1(t, f, lengths(spark, 1_000_001), 2).first()
    assert got["matched"] == 75_000 and got["precision"] == 0.75


def test_calibration_in_bins_by_hand(spark):
    rows = [("f", 0.05, 0), ("f", 0.15, 1), ("f", 1.0, 1), ("g", 0.55, 0)]
    got = {r["family"]: r for r in E.calibration(spark.createDataFrame(rows, "family string, confidence double, correct int")).collect()}
    assert got["f"]["ece"] == pytest.approx((0.05 + 0.85 + 0) / 3) and got["g"]["ece"] == pytest.approx(0.55) and got[None]["n"] == 4
    assert got[None]["brier"] == pytest.approx((0.05**2 + 0.85**2 + 0.55**2) / 4)
    for bad in [("f", 1.5, 1), ("f", float("nan"), 1), ("f", 0.5, 2), ("f", None, 1)]:
        with pytest.raises(Exception, match="a confidence must be"):
            E.calibration(spark.createDataFrame([bad], "family string, confidence double, correct int")).collect()
    for bins in (0, 101):
        with pytest.raises(InvalidInput):
            E.calibration(spark.createDataFrame(rows, "family string, confidence double, correct int"), bins)


def series(spark, x, name="a"):
    return spark.createDataFrame([(name, t, None if v is None else float(v)) for t, v in enumerate(x)], "series_id string, t long, x double")


def test_drift_written_out(spark):
    x = [math.sin(t) + (3 if t > 70 else 0) for t in range(120)]
    w, std, var = 10, np.std(x), np.var(x)
    m = np.array([np.mean(x[i : i + w]) for i in range(111)])
    v = np.array([np.var(x[i : i + w]) for i in range(111)])
    d = [abs(m[i + w] - m[i]) / std + abs(v[i + w] - v[i]) / var for i in range(101)]
    gaps = [y for i, y in enumerate(x) for y in ([None, y] if i % 9 == 2 else [y])]  # missing values are left out first
    for s in (series(spark, x), series(spark, gaps)):
        got = P.drift(s, w).first()
        assert [got[k] for k in ("rolling_mean_drift", "rolling_variance_drift", "regime_change_proxy", "change_density_score")] == pytest.approx([np.std(m) / std, np.std(v) / np.mean(v), max(d), np.mean(np.array(d) > 1)])
    short = P.drift(series(spark, x[:15]), w).first()
    assert short["rolling_mean_drift"] > 0 and short["regime_change_proxy"] == 0.0
    assert P.drift(series(spark, x[:10]), w).first()["rolling_mean_drift"] == 0.0


def test_partial_autocorrelation_by_a_linear_system(spark):
    draw = np.random.default_rng(3)
    x = np.zeros(400)
    for t in range(2, 400):
        x[t] = 0.6 * x[t - 1] - 0.3 * x[t - 2] + draw.normal()
    c = x - x.mean()
    r = [1.0] + [float(np.mean(c[k:] * c[:-k]) / np.var(x)) for k in range(1, 5)]
    want = [np.linalg.solve([[r[abs(i - j)] for j in range(k)] for i in range(k)], r[1 : k + 1])[-1] for k in range(1, 5)]
    got = P.pacf(P.autocovariances(series(spark, x), 4), 4).orderBy("lag").collect()
    assert [g["pacf"] for g in got] == pytest.approx(want)
    assert {g["pacf"] for g in P.pacf(P.autocovariances(series(spark, [1.0] * 40), 4), 4).collect()} == {0.0}


def test_the_last_lag_may_be_a_peak(spark):
    acf = spark.createDataFrame([("a", k + 1, v) for k, v in enumerate([0.5, 0.1, 0.4, 0.2, 0.39])] + [("b", k + 1, v) for k, v in enumerate([-0.1, -0.2, -0.3])], "series_id string, lag int, acf double")
    assert [tuple(r) for r in P.dominant_period(acf).collect()] == [("a", 3, 0.4)]


def test_columns_of_a_series_are_profiled_apart(spark):
    draw = np.random.default_rng(1)
    rows = [("m", t, None, [float(draw.normal()), 5.0 + draw.normal() + (t > 150) * 6, None if t % 2 else 1.0 * (t % 8)]) for t in range(300)]
    s = spark.createDataFrame(rows, "series_id string, t long, ts timestamp, x array<double>")
    each = P.diagnostics(s.select(F.posexplode("x").alias("k", "x"), "t").select(F.col("k").cast("string").alias("series_id"), "t", F.lit(None).cast("timestamp").alias("ts"), "x"))
    got, own = P.diagnostics(s).first(), each.toPandas()
    assert (got["n"], got["dimensions"], got["valid_dimensions"], got["pattern"]) == (300, 3, 3, "random")
    assert got["nan_rate"] == pytest.approx(150 / 900)
    for k in ("kurtosis_proxy", "lag1_autocorr", "regime_change_proxy", "pacf_lagk_proxy"):
        assert got[k] == pytest.approx(float(np.median(own[k])))
    names = {r["pipeline"] for r in recommend(P.diagnostics(s)).collect()}
    assert any(":normal_full_cov:jump=1" in n for n in names)


def test_even_profiles_get_nothing_extra(spark):
    s = series(spark, [math.sin(t * t) for t in range(200)])
    d = P.diagnostics(s)
    base = {r["pipeline"]: r for r in recommend(d).collect()}
    assert base["offline:pelt:l2:jump=1"]["confidence"] < 0.56 * 0.9 + 0.04 + 0.1  # the base of a fallback, without a bonus
    assert resource_estimate("offline:pelt:l1_median:jump=1")["relative_memory"] == 0.45 and resource_estimate("offline:dynp:normal")["relative_time"] == 0.92


def test_poisson_run_lengths_written_out():
    from driftline.operators.online_kernels import make_online

    x = [int(v) for v in np.random.default_rng(5).poisson([4.0] * 30 + [9.0] * 30)]
    steps, post, h = make_online("bocpd", model="poisson", hazard={"mean_run_length": 50}).update_many(x), [1.0], 1 / 50
    for t, v in enumerate(x):
        chance = []
        for held in [0] + [min(r + 1, t) for r in range(t + 1)]:  # a run of length 0 holds the value that began it; gamma prior (1, 1)
            a, b = 1 + sum(x[t - held : t]), 1 + held
            chance.append(math.exp(math.lgamma(a + v) - math.lgamma(a) - math.lgamma(v + 1) + a * math.log(b / (b + 1)) - v * math.log(b + 1)))
        post = [sum(post) * h * chance[0]] + [p * (1 - h) * c for p, c in zip(post, chance[1:], strict=True)]
        post = [p / sum(post) for p in post]
        assert steps[t].p_change == pytest.approx(post[0], abs=1e-9) and steps[t].run_length_mean == pytest.approx(sum(r * p for r, p in enumerate(post)), abs=1e-6)


@pytest.mark.parametrize("n,target", [(0, 3), (3, 3), (10, 1), (10, 0), (10, 4), (1000, 7)])
def test_spread_takes_even_places(n, target):
    got = spread(list(range(n)), target)
    assert len(got) == min(n, target) and got == sorted(set(got))
    if 1 < target < n:
        assert got[0] == 0 and got[-1] == n - 1 and max(np.diff(got)) - min(np.diff(got)) <= 1
