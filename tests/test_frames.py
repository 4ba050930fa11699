"""Operators over frames: against the single-series kernels, streams against batch, files, specs and advice."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.config import Constraints, Stopping
from driftline.errors import EngineError, InvalidInput
from driftline.functions import native as N
from driftline.operators import detect as D
from driftline.operators import diagnostics as P
from driftline.operators import evaluate as E
from driftline.operators import generate as G
from driftline.operators import offline_kernels as K
from driftline.operators import online as O
from driftline.operators import preprocess as R
from driftline.operators import splits as S
from driftline.plans import api
from driftline.plans.recommend import recommend
from driftline.plans.spec import PipelineSpec, ensemble, execute, validate
from driftline.queries import catalogue, streams
from driftline.sources import files
from driftline.streaming import processors


@pytest.fixture(scope="module")
def series(spark):
    s = G.generate(spark, "mean", series=4, n=90, k=1, seed=3, jump=8.0).withColumn("x", F.round("x", 2))
    return s.withColumn("ts", F.lit(None).cast("timestamp")).withColumn("x_fp", F.round(F.col("x") * 100).cast("long")).cache()


def test_detect_series_equals_kernel(spark, series):
    got = {r["series_id"]: r["change_points"] for r in D.detect_series(series, "pelt", "l2", {"pen": 30.0}, {"min_segment_len": 5}).collect()}
    pdf = series.toPandas()
    for sid, own in pdf.groupby("series_id"):
        x = own.sort_values("t")["x"].to_numpy()[:, None]
        assert got[sid] == K.detect(x, "pelt", "l2", Stopping.penalized(30.0), Constraints(min_segment_len=5)).change_points == [45]


def test_chunked_prefixes_equal_plain(spark, series):
    a = N.prefixes(series, {"a": F.col("x_fp")}).orderBy("series_id", "t").collect()
    assert a == N.prefixes(series, {"a": F.col("x_fp")}, chunk=7).orderBy("series_id", "t").collect()


def test_best_split_equals_binseg(spark, series):
    split = {r["series_id"]: r["split"] for r in S.best_split(series).collect()}
    kernel = {r["series_id"]: r["change_points"][0] for r in D.detect_series(series, "binseg", "l2", {"k": 1}).collect()}
    assert split == kernel
    levels = S.binseg_levels(series, 30.0, 2).groupBy("series_id").count().collect()
    assert len(levels) == 4


def test_errors_can_be_rows(spark, series):
    bad = series.withColumn("x", F.when((F.col("series_id") == "1") & (F.col("t") == 3), F.lit(None)).otherwise(F.col("x")))
    got = {r["series_id"]: r for r in D.detect_series(bad, errors="row").collect()}
    assert got["1"]["breakpoints"] == [] and "invalid_input" in got["1"]["diagnostics"]["warnings"][0] and got["0"]["breakpoints"]
    with pytest.raises(EngineError):
        D.detect_series(bad, "nonsense")


def test_segments_and_stats(spark, series):
    results = D.detect_series(series, "dynp", "l2", {"k": 1})
    stats = D.segment_stats(series, results).where("series_id = '0'").orderBy("seg_idx").collect()
    assert [(r["start"], r["end"], r["count"]) for r in stats] == [(0, 45, 45), (45, 90, 45)]
    assert D.change_points(results).count() == 4


def test_window_plans_equal_kernels(spark, series):
    for plan, kind, options in ((O.cusum(series, 0.5, 50.0, 1.0), "cusum", {"drift": 0.5, "threshold": 50.0, "target": 1.0}), (O.page_hinkley(series, 0.5, 50.0), "page_hinkley", {"delta": 0.5, "threshold": 50.0})):
        a = {(r["series_id"], r["t"]): r["p_change"] for r in plan.collect()}
        b = {(r["series_id"], r["t"]): r["p_change"] for r in O.run_online(series, kind, **options).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_stream_equals_batch_and_restart(spark, series, tmp_path):
    rows = series.select("series_id", F.col("t").alias("arrival_seq"), "x")
    rows.where("arrival_seq < 50").write.parquet(str(tmp_path / "in"))
    for part in (rows.where("arrival_seq >= 50"), None):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        processors.run_available(processors.detect_stream(stream, "bocpd"), str(tmp_path / "cp"), str(tmp_path / "out"))
        if part is not None:
            part.write.mode("append").parquet(str(tmp_path / "in"))
    a = {(r["series_id"], r["t"]): r["p_change"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    b = {(r["series_id"], r["t"]): r["p_change"] for r in O.run_online(series, "bocpd").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_stream_gives_refused_rows_a_status(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan")), ("a", 3, 2.0)], "series_id string, arrival_seq bigint, x double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    processors.run_available(processors.detect_stream(stream, "cusum"), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert sorted(r["status"][:7] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["invalid", "ok", "ok"]


def test_preprocessing(spark, series):
    trend = series.withColumn("x", 2.0 * F.col("t") + 1)
    assert R.detrend_linear(trend).agg(F.max(F.abs("x"))).first()[0] < 1e-8
    curve = series.withColumn("x", (F.col("t") * F.col("t")).cast("double"))
    assert R.detrend_polynomial(curve, 2).agg(F.max(F.abs("x"))).first()[0] < 1e-5
    assert R.preprocess(series, {"winsorize": {}, "robust_scale": {}}).count() == series.count()
    for bad in ({"polish": {}},):
        with pytest.raises(InvalidInput):
            R.preprocess(series, bad)
    with pytest.raises(InvalidInput):
        R.winsorize(series, 0.9, 0.1)


def test_metrics_by_hand(spark):
    cps = lambda v: spark.createDataFrame([("a", c) for c in v], "series_id string, cp bigint")
    n = spark.createDataFrame([("a", 100)], "series_id string, n bigint")
    row = E.offline_metrics(cps([20, 50, 80]), cps([22, 51]), n, 3).first()
    assert (row["matched"], row["precision"], row["hausdorff"]) == (2, 1.0, 29) and row["recall"] == pytest.approx(2 / 3)
    assert row["annotation_error"] == pytest.approx((2 + 1) / 2)  # from the found points, which are two
    empty = E.f1(cps([]), cps([]), n).first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (1.0, 1.0, 1.0)


def test_truth_of_generators(spark):
    assert G.even_change_points(300, 2) == [100, 200]
    assert G.truth(spark, 2, 300, 2).count() == 4 and G.registry(spark).count() == 10
    assert G.dataset(spark, "correlated_300").first()["x"] is not None
    a = G.generate(spark, "mean", 2, 50, seed=1).orderBy("series_id", "t").collect()
    assert a == G.generate(spark, "mean", 2, 50, seed=1).repartition(3).orderBy("series_id", "t").collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("u,v\n1,2\n\n3,4\n")
    assert [r["x"] for r in files.read_csv(spark, str(tmp_path / "a.csv")).orderBy("t").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    np.save(tmp_path / "a.npy", np.asfortranarray(np.array([[1, 2], [3, 4]], dtype=">f4")))
    assert [r["x"] for r in files.read_npy(spark, str(tmp_path / "a.npy")).orderBy("t").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    spark.dataSource.register(files.NpyDataSource)
    assert spark.read.format("npy").option("path", str(tmp_path / "a.npy")).load().count() == 2
    assert files.from_rows(spark, np.array([1.0, 2.0]), times=np.array([1, 2])).count() == 2
    with pytest.raises(InvalidInput):
        files.from_rows(spark, np.array([1, 2]))


def test_results_round_trip(spark, series, tmp_path):
    results = D.detect_series(series)
    files.write_results(results, str(tmp_path / "r"))
    back = files.read_results(spark, str(tmp_path / "r"), D.RESULT)
    assert {r["series_id"]: r["change_points"] for r in back.collect()} == {r["series_id"]: r["change_points"] for r in results.collect()}
    assert files.migrate({"breakpoints": [3, 9], "extra": 1})["change_points"] == [3]
    with pytest.raises(InvalidInput):
        files.migrate({"breakpoints": [3], "schema_version": 9})


def test_specs_and_command_line(spark, series, tmp_path, capsys):
    spec = PipelineSpec.parse({"kind": "pelt"})
    assert spec.detector == "pelt" and PipelineSpec.parse(spec.to_json()) == spec
    assert execute(series, PipelineSpec.parse({"detector": "cusum"})).count() == series.count()
    (tmp_path / "a.csv").write_text("\n".join(str(v) for v in [0.0] * 20 + [9.0] * 20))
    assert api.main(["detect", "--input", str(tmp_path / "a.csv"), "--penalty", "5"]) == 0
    assert json.loads(capsys.readouterr().out)["change_points"] == [20]
    assert api.main(["eval", "--truth", "[20]", "--predicted", "[21]", "--n", "40"]) == 0
    assert json.loads(capsys.readouterr().out)["hausdorff"] == 1
    assert api.main(["detect", "--input", str(tmp_path / "a.csv"), "--detector", "nothing"]) == 2


def test_command_line_errors_have_codes(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("1\n2\n")
    (tmp_path / "bad.json").write_text("{")
    code = lambda *args: (api.main(list(args)), json.loads(capsys.readouterr().err)["error"]["code"])
    assert code("run", "--input", str(tmp_path / "a.csv"), "--pipeline", str(tmp_path / "none.json")) == (2, "io_error")
    assert code("run", "--input", str(tmp_path / "a.csv"), "--pipeline", str(tmp_path / "bad.json")) == (2, "json_error")
    assert code("detect", "--input", str(tmp_path / "none.csv")) == (2, "io_error")


def test_results_of_unknown_versions_are_refused(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"breakpoints": [2], "diagnostics": {"schema_version": 3}}) + "\n")
    with pytest.raises(Exception, match="schema version 3"):
        files.read_results(spark, str(tmp_path / "r.json"), "breakpoints array<bigint>").collect()
    (tmp_path / "r.json").write_text(json.dumps({"breakpoints": [2], "diagnostics": {"schema_version": 2}}) + "\n")
    assert files.read_results(spark, str(tmp_path / "r.json"), "breakpoints array<bigint>").first()["breakpoints"] == [2]


def test_consensus_and_validation(spark, series):
    specs = [{"detector": "pelt", "stopping": {"pen": 30.0}}, {"detector": "binseg", "stopping": {"pen": 30.0}}]
    assert {(r["change_point"], r["votes"]) for r in ensemble(series, specs).collect()} == {(45, 2)}
    row = validate(series, specs).first()
    assert row["stability"] == 1.0 and row["agreement"] == 1.0 and row["penalty_sensitivity"] == 0.0


def test_advice(spark, series):
    profiles = P.diagnostics(series)
    assert profiles.count() == 4
    top = recommend(profiles).where("place = 1").collect()
    assert len(top) == 4 and all(r["pipeline"].startswith("offline:") for r in top)
    assert recommend(profiles, "speed", online=True).where("pipeline = 'online:cusum'").count() == 4
    assert all(r["abstained"] for r in recommend(profiles, min_confidence=0.999).collect())


def test_sql_function(spark, series):
    api.register_sql(spark)
    series.createOrReplaceTempView("rows_of_series")
    got = spark.sql("SELECT * FROM detect_changes('pelt', 'normal', TABLE(SELECT series_id, t, x FROM rows_of_series) PARTITION BY series_id ORDER BY t)").collect()
    assert {r["series_id"] for r in got} == {"0", "1", "2", "3"}


def test_queries_have_names_and_sql():
    q, o = catalogue.queries(), catalogue.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90 and "best_split_l2" in q
    assert streams.QUERIES


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
