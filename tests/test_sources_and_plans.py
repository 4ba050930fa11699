"""Files in splits, stored documents, consensus, validation, advice, and the SQL function, on cases worked out by hand."""

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.config import LatePolicy
from driftline.errors import InvalidInput
from driftline.operators import diagnostics as P
from driftline.operators import preprocess as R
from driftline.operators.online_kernels import make_online
from driftline.plans import api
from driftline.plans.recommend import recommend
from driftline.plans.spec import PipelineSpec, cluster, ensemble, run_specs, validate
from driftline.sources import documents as J
from driftline.sources import files
from driftline.streaming import processors as S

# --- files


def parse_csv(body):
    """The rule, line by line."""
    rows = [[c.strip() for c in ln.strip().split(",")] for ln in body.splitlines() if ln.strip()]

    def number(c):
        try:
            return float(c)
        except ValueError:
            return None

    def parsed(part):
        got = [[number(c) for c in r] for r in part]
        ok = got and len({len(r) for r in got}) == 1 and all(v is not None for r in got for v in r)
        return got if ok else None

    got = parsed(rows)
    if got is None and len(rows) > 1 and len(rows[0]) == len(rows[1]) and all(c and number(c) is None for c in rows[0]):
        got = parsed(rows[1:])
    return got


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_in_many_splits(spark, tmp_path, small_splits):
    draw = np.random.default_rng(0)
    bodies = {
        "plain": "\n".join(f"{v:.3f}, {w:.3e}" for v, w in draw.normal(size=(400, 2))),
        "header": "u , v\n\n" + "\n\n".join(f"{v:.3f},{w:.3f}" for v, w in draw.normal(size=(300, 2))) + "\n\n",
        "one": "7\n",
        "short": "name\r\n1.5\r\n-inf\r\nnan\r\n",
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.csv").write_bytes(body.encode())
    frame = files.read_csv(spark, str(tmp_path))
    assert files._numbered_lines(spark, str(tmp_path)).select("_file", "t").distinct().count() == sum(len([x for x in b.splitlines() if x.strip()]) for b in bodies.values())
    got = {}
    for r in frame.collect():
        got.setdefault(r["series_id"].rsplit("/", 1)[-1].removesuffix(".csv"), {})[r["t"]] = r["x"]
    for name, body in bodies.items():
        want = parse_csv(body)
        assert sorted(got[name]) == list(range(len(want))) and repr([got[name][t] for t in range(len(want))]) == repr(want)
    assert spark.read.text(str(tmp_path / "plain.csv")).rdd.getNumPartitions() > 5


@pytest.mark.parametrize(("body", "why"), [("1,2\n3\n", "as long"), ("a,b", "line 1 "), ("1\nb\n", "line 2 "), ("a,b\n1,2\n3,\n", "line 3 "), ("a,2\n1,2\n", "line 1 "), ("a\n1,2\n", "line 1 "), ("a,b\n1,2\n3\n", "line 1 |as long")])
def test_csv_that_is_no_table(spark, tmp_path, body, why):
    (tmp_path / "x.csv").write_text(body)
    assert parse_csv(body) is None
    with pytest.raises(Exception, match=why):
        files.read_csv(spark, str(tmp_path / "x.csv")).collect()


@pytest.mark.parametrize("dtype", ["<f4", ">f8"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_npy_by_ranges_of_rows(spark, tmp_path, dtype, order):
    x = np.asarray(np.random.default_rng(1).normal(size=(500, 3)), dtype=dtype, order=order)
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", np.arange(7, dtype=dtype))
    spark.dataSource.register(files.NpyDataSource)
    frame = spark.read.format("npy").option("bytes_per_partition", 1000).load(str(tmp_path))
    assert frame.rdd.getNumPartitions() > 6
    rows = frame.collect()
    a = [r["x"] for r in sorted((r for r in rows if r["series_id"].endswith("a.npy")), key=lambda r: r["t"])]
    assert a == x.astype(float).tolist() and [r["x"] for r in rows if r["series_id"].endswith("b.npy")] == [[float(i)] for i in range(7)]


def test_npy_that_is_no_series(spark, tmp_path):
    for name, x in {"ints": np.arange(3), "cube": np.zeros((2, 2, 2)), "none": np.zeros((0, 2))}.items():
        np.save(tmp_path / f"{name}.npy", x)
        with pytest.raises(InvalidInput):
            files.NpyFile(str(tmp_path / f"{name}.npy"))
    np.save(tmp_path / "cut.npy", np.zeros(100))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="ends before"):
        files.read_npy(spark, str(tmp_path / "cut.npy")).collect()
    with pytest.raises(Exception, match="does not exist"):
        files.read_npy(spark, str(tmp_path / "nothing.npy")).collect()


# --- documents


def documents(spark, tmp_path, *bodies):
    (tmp_path / "docs").mkdir(exist_ok=True)
    for i, body in enumerate(bodies):
        (tmp_path / "docs" / f"{i}.json").write_text(json.dumps(body, indent=1))
    return J.read_json(spark, str(tmp_path / "docs"))


def result(version=1, **more):
    return {"breakpoints": [30, 70], "change_points": [30], "scores": None, "diagnostics": {"n": 70, "d": 1, "schema_version": version, "notes": [], "algorithm": "pelt", **more.pop("inner", {})}, **more}


def test_results_of_two_versions_keep_what_is_unknown(spark, tmp_path):
    docs = documents(spark, tmp_path, result(), result(2, fresh={"a": [1, None]}, inner={"later": "x"}))
    got = sorted(J.migrated(docs, "result").select("schema_version", "breakpoints", "change_points", F.to_json("unknown").alias("u"), F.to_json("unknown_diagnostics").alias("v")).collect())
    assert [tuple(r)[:3] for r in got] == [(1, [30, 70], [30]), (2, [30, 70], [30])]
    assert [json.loads(r["u"]) for r in got] == [{}, {"fresh": {"a": [1, None]}}] and [json.loads(r["v"]) for r in got] == [{}, {"later": "x"}]
    back = sorted((json.loads(r["value"]) for r in J.rewritten(docs, "result").collect()), key=len)
    assert back == [result(), result(1, fresh={"a": [1, None]}, inner={"later": "x"})]


def test_constraints_and_diagnostics_documents(spark, tmp_path):
    body = {"schema_version": 2, "min_segment_len": 4, "jump": 3, "max_depth": None, "cache_policy": {"Budgeted": 9}, "candidate_splits": [5, 10], "later": True}
    row = J.migrated(documents(spark, tmp_path, body), "constraints").select("*", F.to_json("cache_policy").alias("p"), F.to_json("unknown").alias("u")).first()
    assert (row["schema_version"], row["min_segment_len"], row["max_depth"], row["candidate_splits"], row["p"], row["u"]) == (2, 4, None, [5, 10], '{"Budgeted":9}', '{"later":true}')
    row = J.migrated(documents(spark, tmp_path, {"n": 5, "schema_version": 1, "pruning_stats": {"candidates_considered": 3, "candidates_pruned": 1}}), "diagnostics").first()
    assert row["n"] == 5 and row["pruning_stats"]["candidates_pruned"] == 1


@pytest.mark.parametrize(("kind", "body", "why"), [("result", result(3), "schema version 3"), ("constraints", {"jump": 1}, "schema version .none."), ("result", result() | {"breakpoints": [5, 5]}, "strictly"), ("result", result() | {"breakpoints": []}, "strictly")])
def test_documents_that_are_refused(spark, tmp_path, kind, body, why):
    with pytest.raises(Exception, match=why):
        J.migrated(documents(spark, tmp_path, body), kind).collect()


def test_checkpoints_of_both_forms(spark, tmp_path):
    state = {"t": 4, "score": 0.5, "watermark_ns": None}
    inner = json.dumps(state, separators=(",", ":"), sort_keys=True)
    old = {"schema_version": 0, "detector_id": "cusum", "engine_version": "0.9", "created_at_ns": 5, "payload_codec": "json", "payload_crc32": f"{zlib.crc32(inner.encode()):08x}", "payload": state}
    raw = json.dumps(state, separators=(",", ":"))
    new = {"detector_id": "cusum", "state_schema_version": 1, "engine_fingerprint": "e/1", "created_at_ns": 6, "payload_codec": "json", "payload_crc32": zlib.crc32(raw.encode()), "payload": list(raw.encode()), "later": 1}
    got = sorted(J.checkpoints(documents(spark, tmp_path, old, new)).select("state_schema_version", "engine", "payload", "intact", F.to_json("unknown").alias("u")).collect())
    assert [(r["state_schema_version"], r["engine"], json.loads(r["payload"]), r["intact"], r["u"]) for r in got] == [(0, "0.9", state, True, "{}"), (1, "e/1", state, True, '{"later":1}')]
    bad = J.checkpoints(documents(spark, tmp_path, old | {"payload": state | {"t": 5}}, new | {"payload_crc32": 1}))
    assert {r["intact"] for r in bad.collect()} == {False}
    with pytest.raises(Exception, match="codec"):
        J.checkpoints(documents(spark, tmp_path, old | {"payload_codec": "bin"})).collect()


# --- consensus and validation


def test_clusters_have_one_point_of_each_pipeline():
    assert cluster([[10, 30], [11], [12, 13]], 3) == [(11, 3), (30, 1)]  # 12 is nearer to the anchor 11 than 13
    assert cluster([[10], [14], [12]], 2) == [(12, 2), (14, 1)]  # 12 is as near to both: the older group; the upper median moves
    assert cluster([[10], [12], [14]], 2) == [(12, 3)] and cluster([[10], [12], [14]], 2, moving=False) == [(10, 2), (14, 1)]
    assert cluster([[], []], 2) == [] and cluster([[5, 6]], 3) == [(5, 1)]


@pytest.fixture
def steps(spark):
    rows = [(k, t, float(t % 2) + (20.0 if t >= 40 else 0.0)) for k in "ab" for t in range(80)] + [("c", t, 1.0) for t in range(3)]
    return spark.createDataFrame(rows, "series_id string, t long, x double")


def test_consensus_counts_pipelines_that_failed(spark, steps):
    specs = [{"detector": "pelt", "stopping": {"pen": 30.0}}, {"detector": "dynp", "stopping": {"k": 3}, "constraints": {"min_segment_len": 30}}, {"detector": "cusum"}]
    rows = {(r["series_id"], r["voter"]): r["note"] for r in run_specs(steps, [PipelineSpec.parse(x) for x in specs[:2]]).collect()}
    assert rows["a", 0] is None and rows["a", 1] is not None  # three changes do not fit
    got = {(r["series_id"], r["change_point"], r["votes"], r["attempted"]) for r in ensemble(steps, specs, min_ratio=0.5).collect()}
    assert got == {("a", 40, 1, 2), ("b", 40, 1, 2)}
    assert ensemble(steps, specs, min_ratio=0.6).count() == 0
    for bad in ([], [{"detector": "cusum"}]):
        with pytest.raises(InvalidInput):
            ensemble(steps, bad)


def test_validation_fills_thins_and_survives(spark, steps):
    gaps = steps.withColumn("x", F.when((F.col("t") % 7 != 3) & (F.col("t") != 0), F.col("x")))
    specs = [{"detector": "pelt", "stopping": {"pen": 30.0}}, {"detector": "binseg", "stopping": {"pen": 30.0}, "preprocess": {"winsorize": {}}}, {"detector": "dynp", "stopping": {"k": 1}}]
    got = {r["series_id"]: r for r in validate(gaps, specs, stride=2).collect()}
    assert got["a"]["stability"] == 1.0 and got["a"]["agreement"] == 1.0 and got["a"]["penalty_sensitivity"] == 0.0 and got["a"]["ran"] == 3
    assert validate(gaps, [specs[2]]).where("series_id = 'a'").first()["penalty_sensitivity"] is None
    assert got["c"]["ran"] < 3 or got["c"]["stability"] is not None  # a series that is too short stops no other
    many = gaps.withColumn("x", F.array("x", F.lit(1.0)))
    assert validate(many, specs[:2]).where("series_id = 'b'").first()["stability"] == 1.0


# --- advice


PROFILE = {
    "series_id": "p", "n": 500, "missing": 0, "nan_rate": 0.0, "longest": 0, "pattern": "none", "dimensions": 1, "valid": 500, "valid_dimensions": 1, "kurtosis_proxy": 2.5, "outlier_rate_iqr": 0.0,
    "mad_to_std_ratio": 1.0, "std": 1.0, "robust_std": 1.0, "lag1_autocorr": 0.1, "lagk_autocorr": 0.1, "pacf_lagk_proxy": 0.0, "residual_lag1_autocorr": 0.1, "rolling_mean_drift": 0.0,
    "rolling_variance_drift": 0.0, "regime_change_proxy": 0.5, "change_density_score": 0.2, "used_subsampling": False, "binary_like": False, "count_like": False, "period": 5, "strength": 0.1,
}


def profile(spark, **more):
    return spark.createDataFrame([tuple((PROFILE | more).values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'long'}" for k, v in PROFILE.items()))


def strongest(spark, **more):
    return P.strongest_signal(P.signal_flags(profile(spark, **more))).first()


def test_scores_of_signals_decide(spark):
    assert strongest(spark, count_like=True, lag1_autocorr=0.55 * 1.7)["strongest"] == "count_like"  # 1.8 against 1.7
    assert strongest(spark, count_like=True, lag1_autocorr=0.55 * 1.81)["strongest"] == "autocorrelated"
    assert strongest(spark, change_density_score=0.01, regime_change_proxy=0.1, nan_rate=0.2)["strongest"] == "low_signal"  # 1 + 0.8 + 0.6 against 2
    assert strongest(spark, pattern="block")["strongest"] == "masking_risk" and strongest(spark)["strongest"] is None
    assert strongest(spark, dimensions=5, valid_dimensions=2)["conflicting_signals"] and not strongest(spark, dimensions=4, valid_dimensions=2)["conflicting_signals"]


def test_very_long_series_are_thinned_in_the_name(spark):
    names = {r["pipeline"] for r in recommend(profile(spark, n=150_000, kurtosis_proxy=9.0, lag1_autocorr=0.9)).collect()}
    assert names == {"offline:pelt:ar:jump=6", "offline:pelt:nig:jump=6", "offline:fpop:l2:jump=6", "offline:pelt:l2:jump=6"}
    assert {r["pipeline"] for r in recommend(profile(spark, n=10_000_000)).collect()} == {"offline:fpop:l2:jump=16", "offline:pelt:l2:jump=16"}
    assert {r["pipeline"] for r in recommend(profile(spark, n=50_000, kurtosis_proxy=9.0)).collect()} == {"offline:binseg:l1_median:jump=1", "offline:pelt:l2:jump=1"}
    assert PipelineSpec.of_recommendation("offline:pelt:ar:jump=6").constraints.jump == 6 and PipelineSpec.of_recommendation("offline:binseg:l1_median:jump=1").cost == "l1"
    assert PipelineSpec.of_recommendation("online:bocpd:poisson:max_run_length=2000").options == {"model": "poisson", "max_run_length": 2000}
    with pytest.raises(Exception, match="one column"):
        recommend(profile(spark, dimensions=2), online=True).collect()


def test_seasons_by_size_of_correlation_and_means_over_columns(spark):
    rows = [("s", t, [float((-1) ** (t // 3)), float(t % 5 == 0)]) for t in range(120)]
    got = P.preprocessing_advice(spark.createDataFrame(rows, "series_id string, t long, x array<double>")).first()
    first = np.array([r[2][0] for r in rows])
    assert got["best_lag"] in (3, 6) and got["difference_by"] == got["best_lag"]  # a turn of sign after three rows is as strong as a period of six
    assert abs(np.corrcoef(first[3:], first[:-3])[0, 1]) == pytest.approx(1.0)
    assert P.preprocessing_advice(spark.createDataFrame([("s", t, 1.0) for t in range(2)], "series_id string, t long, x double")).count() == 0


def test_a_pass_gives_what_the_plans_give(spark):
    draw = np.random.default_rng(3)
    x = [None if t % 11 == 4 else float(draw.normal() + (t > 200) * 2 + math.sin(t / 3)) for t in range(400)]
    s = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "series_id string, t long, x double")
    got = P.diagnostics(s).first()
    plans = [P.shape(s), P.drift(s), P.residual_lag1(s), P.pacf(P.autocovariances(s, 8), 8).where("lag = 8").select("series_id", F.col("pacf").alias("pacf_lagk_proxy"))]
    for plan in plans:
        row = plan.first().asDict()
        assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in row.items() if k in P.MEASURES), row
    acf = P.autocorrelations(s, range(1, 129))
    period = P.dominant_period(P.supported(acf, s)).first()
    assert (got["period"], got["strength"]) == (period["period"], pytest.approx(period["strength"])) and got["lag1_autocorr"] == pytest.approx(acf.where("lag = 1").first()["acf"])


def test_samples_of_long_series_are_bounded(spark):
    s = spark.range(250_001).select(F.lit("a").alias("series_id"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    cut = P.subsampled(s).orderBy("t").select("t", "x").collect()
    assert [r["t"] for r in cut] == list(range(len(cut))) and len(cut) <= P.SUBSAMPLE_ABOVE and cut[0]["x"] == 0 and cut[-1]["x"] == 250_000


# --- preprocessing


def test_seasons_of_short_series_shrink_the_window(spark):
    x, period = [math.sin(t) + t / 5 for t in range(12)], 8

    def trend(v):
        half = 5  # the largest odd number of rows is 11
        return [np.mean(v[max(0, t - half) : t + half + 1]) for t in range(12)]

    clean = list(x)
    for _ in range(2):
        rest = [a - b for a, b in zip(x, trend(clean))]
        profile_ = [np.mean(rest[p::period]) for p in range(period)]
        clean = [v - (profile_[t % period] - np.mean(profile_)) for t, v in enumerate(x)]
    s = spark.createDataFrame([("a", t, v) for t, v in enumerate(x)], "series_id string, t long, x double")
    assert [r["x"] for r in R.stl_like(s, period).orderBy("t").collect()] == pytest.approx(clean)
    for f in (R.stl_like, R.difference):
        with pytest.raises(Exception, match="below the length"):
            f(s, 12).collect()


# --- entry points


def test_sql_function_names_its_columns(spark, steps):
    api.register_sql(spark)
    steps.select(F.col("series_id").alias("who"), F.col("t").alias("at"), F.col("x").alias("v")).createOrReplaceTempView("named")
    steps.where("series_id = 'a'").select("t", "x").createOrReplaceTempView("lone")
    call = lambda text: {tuple(r) for r in spark.sql(f"SELECT * FROM changes_of({text})").collect()}
    assert call("TABLE(named), series => 'who', by => 'at', value => 'v', penalty => 30.0, min_segment_len => 5") == {("a", 40), ("b", 40)}
    assert call("TABLE(lone), detector => 'dynp', k => 1, jump => 5") == {("series", 40)}
    for text, why in {"TABLE(named), by => 'at', value => 'v', series => 'none'": "no column", "TABLE(lone), k => 1, penalty => 2.0": "exclude", "TABLE(lone), size => 3": "unknown argument", "TABLE(lone), detector => 'x'": "unknown detector", "TABLE(named), by => 'at', value => 'who'": "numeric"}.items():
        with pytest.raises(Exception, match=why):
            call(text)


def test_one_array_with_preprocessing_and_diagnostics(spark):
    x = np.array([0.0] * 40 + [5.0] * 40) + np.random.default_rng(0).normal(size=80) / 10
    x[7] = 900.0
    spec = {"detector": "dynp", "stopping": {"k": 1}, "preprocess": {"winsorize": {"lower_quantile": 0.02, "upper_quantile": 0.98}}}
    outcome, row = api.detect_offline(x, pipeline=spec, return_diagnostics=True)
    assert outcome.change_points == [40] and row["n"] == 80
    assert api.detect_offline(x[:10], detector="pelt", return_diagnostics=True)[1] is None


def test_counters_of_a_stream_equal_a_plain_count(spark, tmp_path):
    times = [0, 30, 40, 20, 10, 50, 5, 60, 70, 1, 2, 3]
    rows = [("a", i, t, float(i)) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "series_id string, arrival_seq long, t_ns long, x double").coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("series_id string, arrival_seq long, t_ns long, x double").parquet(str(tmp_path / "rows"))
    late = LatePolicy("reorder", 10**18, 2, "drop_oldest")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run = S.run_available(S.detect_stream(stream, "cusum", late=late), str(tmp_path / "c"), str(tmp_path / "out"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    model = make_online("cusum", late=late)
    for _, _, t, x in rows:
        model.update(x, t)
    assert run.counters == model.counters and run.rows == 12 and run.counters["late"] == 6 and run.counters["reordered"] == 1 and run.counters["dropped_oldest"] == 1
    assert sum(run.batch_ms) > 0 and run.us_per_row > 0
    out = spark.read.schema(S.OUTPUT).parquet(str(tmp_path / "out"))
    assert out.where("processing_latency_us is not null").count() == 0 and out.agg(F.sum("buffered")).first()[0] == model.counters["buffered"]
