"""Profiles, advice and pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as P
from ..plans.api import register_sql
from ..plans.recommend import CALIBRATION, FEATURES, recommend
from ..plans.spec import PipelineSpec, ensemble, execute, validate
from ..sources import tables as T
from .base import BLOCKS, ERRORS, EVENTS, ORDERS, USERS
from .detectors import _L2, _optimal


def missing_overview(spark, d):
    return P.missing_overview(T.with_gaps(T.events(spark, d), "block")).select("series_id", "n", "missing", F.round("nan_rate", 6).alias("nan_rate"), "longest", "pattern")


def autocorrelations(spark, d):
    return P.autocorrelations(T.events(spark, d), [1, 2, 3, 7]).select("series_id", "lag", F.round("acf", 6).alias("acf"))


def pacf(spark, d):
    return P.pacf(P.autocovariances(T.events(spark, d), 3), 3).select("series_id", "lag", F.round("pacf", 6).alias("pacf"))


def dominant_period(spark, d):
    s = T.events(spark, d)
    return P.dominant_period(P.supported(P.autocorrelations(s, range(1, P.MAX_LAG + 1)), s)).select("series_id", "period", F.round("strength", 6).alias("strength"))


def period_votes(spark, d):
    s = T.events(spark, d, "user_id")
    return P.period_votes(P.dominant_period(P.supported(P.autocorrelations(s, range(1, P.MAX_LAG + 1)), s))).select("period", F.round("strength", 5).alias("strength"), "place")


def residual_lag1(spark, d):
    return P.residual_lag1(T.events(spark, d)).select("series_id", F.round("residual_lag1_autocorr", 5).alias("residual_lag1_autocorr"))


def shape(spark, d):
    return P.shape(T.events(spark, d)).select("series_id", "valid", F.round("kurtosis_proxy", 4).alias("kurtosis_proxy"), F.round("outlier_rate_iqr", 6).alias("outlier_rate_iqr"), F.round("mad_to_std_ratio", 5).alias("mad_to_std_ratio"))


def drift(spark, d):
    r = lambda c: F.round(c, 4).alias(c)
    return P.drift(T.events(spark, d)).select("series_id", r("rolling_mean_drift"), r("rolling_variance_drift"), r("regime_change_proxy"), r("change_density_score"))


def hints(spark, d):
    """Series of flags, of counts and of neither."""
    rows = [T.error_flags(spark, d), T.orders_daily(spark, d), T.events(spark, d)]
    return P.hints(rows[0].select("series_id", "x").unionByName(rows[1].select("series_id", "x")).unionByName(rows[2].select("series_id", "x")))


def _measures():
    return [F.round(k, 4).alias(k) for k in P.MEASURES]


def diagnostics(spark, d):
    out = P.diagnostics(T.events(spark, d))
    return out.select("series_id", "n", "missing", F.round("nan_rate", 6).alias("nan_rate"), "longest", "pattern", "dimensions", "valid", "valid_dimensions", *_measures(), "used_subsampling", "binary_like", "count_like", "period", F.round("strength", 6).alias("strength"))


def diagnostics_gaps(spark, d):
    """Users with a block of missing values, in three columns: the value, whether it is an error, and a constant that is mostly missing."""
    s = T.with_gaps(T.events(spark, d, "user_id"), "block")
    s = s.select("series_id", "t", F.array("x", F.when(F.col("x") > 50, 1.0).otherwise(0.0), F.when(F.col("t") % 4 == 0, 3.0)).alias("x"))
    out = P.diagnostics(s)
    return out.select("series_id", "n", "missing", F.round("nan_rate", 6).alias("nan_rate"), "longest", "pattern", "dimensions", "valid", "valid_dimensions")


def signal_flags(spark, d):
    return P.strongest_signal(P.signal_flags(P.diagnostics(T.events(spark, d)))).select("series_id", "huge_n", "medium_n", "autocorrelated", "heavy_tail", "change_dense", "few_strong_changes", "masking_risk", "low_signal", "conflicting_signals", "strongest")


def preprocessing_advice(spark, d):
    r = lambda c: F.round(c, 5).alias(c)
    return P.preprocessing_advice(T.events(spark, d)).select("series_id", "detrend", "difference_by", "winsorize", "robust_scale", r("trend_strength"), r("seasonality_strength"), "best_lag", r("outlier_rate"), r("scale_instability"))


def _advice(rows):
    r = lambda c: F.round(c, 4).alias(c)
    return rows.select("series_id", "place", "pipeline", r("score"), r("confidence"), r("low"), r("high"), "calibration", "strongest", "abstained")


def recommendations(spark, d):
    return _advice(recommend(P.diagnostics(T.events(spark, d))))


def recommendations_online(spark, d):
    return _advice(recommend(P.diagnostics(T.events(spark, d)), "speed", online=True))


def pipeline_spec(spark, d):
    spec = PipelineSpec.parse({"detector": {"kind": "pelt"}, "cost": "l2", "stopping": {"pen": 9000.0}, "preprocess": {"winsorize": {}}})
    return execute(T.events(spark, d, "user_id"), spec).select("series_id", F.size("change_points").alias("changes"))


def consensus(spark, d):
    specs = [{"detector": "pelt", "stopping": {"pen": 9000.0}}, {"detector": "binseg", "stopping": {"pen": 9000.0}}, {"detector": "dynp", "stopping": {"k": 1}}]
    return ensemble(T.events(spark, d, "user_id"), specs)


def validation(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    out = validate(T.with_gaps(T.events(spark, d, "user_id")), [{"detector": "pelt", "stopping": {"pen": 9000.0}}, {"detector": "binseg", "stopping": {"pen": 9000.0}}], stride=2)
    return out.select("series_id", r("stability"), r("agreement"), r("penalty_sensitivity"), "ran")


def sql_function(spark, d):
    """Change points through SQL, with a penalty and a least length of segments."""
    register_sql(spark)
    T.events(spark, d, "user_id").select(F.col("series_id").alias("who"), F.col("t").alias("place"), F.col("x").alias("amount")).createOrReplaceTempView("amounts_of_users")
    return spark.sql("SELECT * FROM changes_of(TABLE(amounts_of_users), penalty => 9000.0, min_segment_len => 5, series => 'who', by => 'place', value => 'amount')")


_ACF = "SELECT series_id, {k} AS lag, round(corr(x, l{k}), 6) AS acf FROM l GROUP BY 1"
_LAGS = f"WITH {EVENTS}, l AS (SELECT series_id, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3, lag(x, 7) OVER w AS l7 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t))"
_PERIODS = """, z AS (SELECT series_id, least(128, count(*) // 4) AS top_lag FROM s GROUP BY 1), k AS (SELECT unnest(range(1, 129)) AS lag),
c AS (SELECT a.series_id, lag, greatest(coalesce(corr(b.x, a.x), 0), 0) AS acf FROM s a JOIN z USING (series_id) JOIN k ON lag <= top_lag JOIN s b ON b.series_id = a.series_id AND b.t = a.t + lag GROUP BY 1, 2),
n AS (SELECT *, lag(acf) OVER w AS l, coalesce(lead(acf) OVER w, acf) AS r FROM c WINDOW w AS (PARTITION BY series_id ORDER BY lag)),
p AS (SELECT series_id, lag, acf, acf >= l AND acf >= r AS peak FROM n WHERE lag >= 2 AND acf > 1e-12), q AS (SELECT *, bool_or(peak) OVER (PARTITION BY series_id) AS has_peak FROM p),
o AS (SELECT *, max(acf) OVER (PARTITION BY series_id) AS top FROM q WHERE peak OR NOT has_peak),
d AS (SELECT series_id, min(lag) AS period, arg_min(acf, lag) AS strength FROM o WHERE acf >= 0.95 * top GROUP BY 1)"""
_GAPS = f"""WITH {USERS}, g AS (SELECT series_id, t, CASE WHEN t BETWEEN 40 AND 59 THEN NULL ELSE x END AS x FROM s),
c AS (SELECT series_id, t, 0 AS dim, x FROM g UNION ALL SELECT series_id, t, 1, CASE WHEN x > 50 THEN 1 ELSE 0 END FROM g UNION ALL SELECT series_id, t, 2, CASE WHEN t % 4 = 0 THEN 3 END FROM g),
i AS (SELECT series_id, dim, t - row_number() OVER (PARTITION BY series_id, dim ORDER BY t) AS k FROM c WHERE x IS NULL), r AS (SELECT series_id, dim, max(k) AS longest FROM (SELECT series_id, dim, k AS g, count(*) AS k FROM i GROUP BY 1, 2, 3) GROUP BY 1, 2),
o AS (SELECT c.series_id, c.dim, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS missing, coalesce(any_value(longest), 0) AS longest, count(x) AS valid FROM c LEFT JOIN r ON r.series_id = c.series_id AND r.dim = c.dim GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN missing = 0 THEN 'none' WHEN longest >= greatest(8, ceil(missing / 4)) THEN 'block' ELSE 'random' END AS pattern FROM o)
SELECT series_id, max(n) AS n, sum(missing)::BIGINT AS missing, round(sum(missing) / sum(n), 6) AS nan_rate, max(longest) AS longest,
  CASE WHEN sum(missing) = 0 THEN 'none' WHEN coalesce(sum(missing) FILTER (WHERE pattern = 'block'), 0) >= coalesce(sum(missing) FILTER (WHERE pattern = 'random'), 0) THEN 'block' ELSE 'random' END AS pattern,
  count(*) AS dimensions, sum(valid) FILTER (WHERE valid >= 32)::BIGINT AS valid, count(*) FILTER (WHERE valid >= 32) AS valid_dimensions FROM p GROUP BY 1 HAVING count(*) FILTER (WHERE valid >= 32) > 0"""
_HINTS = f"""WITH a AS (WITH {ERRORS} SELECT series_id, x_fp::DOUBLE AS x FROM s), b AS (WITH {ORDERS} SELECT series_id, x_fp::DOUBLE AS x FROM s), c AS (WITH {EVENTS} SELECT series_id, x FROM s),
v AS (SELECT series_id, abs(x - round(x)) <= 1e-9 AS whole, x FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)),
h AS (SELECT series_id, avg(CASE WHEN whole AND round(x) IN (0, 1) THEN 1 ELSE 0 END) AS bin, avg(CASE WHEN whole AND x >= -1e-9 THEN 1 ELSE 0 END) AS cnt FROM v GROUP BY 1)
SELECT series_id, bin >= 0.98 AS binary_like, cnt >= 0.98 AND bin < 0.98 AS count_like FROM h"""

_PROFILE = f"""WITH RECURSIVE {EVENTS}{_PERIODS}, bs AS (
  SELECT series_id, count(*) AS n, count(x) AS valid, avg(x) AS mu, var_pop(x) AS var, median(x) AS med, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM s GROUP BY 1
), mo AS (
  SELECT s.series_id, avg((x - mu) ^ 4) / any_value(var) ^ 2 AS kurtosis_proxy, count(*) FILTER (WHERE x < lo - 1.5 * (hi - lo) OR x > hi + 1.5 * (hi - lo)) / count(*) AS outlier_rate_iqr, median(abs(x - med)) AS mad,
    avg(CASE WHEN x IN (0, 1) THEN 1 ELSE 0 END) AS bin, avg(CASE WHEN abs(x - round(x)) <= 1e-9 AND x >= -1e-9 THEN 1 ELSE 0 END) AS cnt, abs(corr(x, t)) AS trend,
    count(*) FILTER (WHERE abs(x - med) > 3.5 * 1.4826 * (SELECT median(abs(u.x - bs.med)) FROM s u WHERE u.series_id = s.series_id)) / count(*) AS far
  FROM s JOIN bs USING (series_id) GROUP BY s.series_id
), al AS (SELECT a.series_id, k.lag, corr(b.x, a.x) AS r, avg((a.x - mu) * (b.x - mu)) / any_value(var) AS cov FROM s a JOIN bs USING (series_id) JOIN k ON true JOIN s b ON b.series_id = a.series_id AND b.t = a.t + k.lag GROUP BY 1, 2),
dl AS (
  SELECT series_id, list(cov ORDER BY lag) AS r, 0 AS k, []::DOUBLE[] AS phi, 1::DOUBLE AS noise, 0::DOUBLE AS a FROM al WHERE lag <= 8 GROUP BY 1
  UNION ALL
  SELECT series_id, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - v * phi[k + 1 - i]), v), noise * (1 - v * v), v FROM (
    SELECT *, (r[k + 1] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 1 - i])), 0)) / noise AS v FROM dl WHERE k < 8)
), tr AS (SELECT series_id, regr_slope(x, t) AS b, regr_intercept(x, t) AS a FROM s GROUP BY 1), rs AS (SELECT s.series_id, t, x - a - b * t AS x FROM s JOIN tr USING (series_id)),
r1 AS (SELECT series_id, corr(x, y) AS r FROM (SELECT series_id, x, lag(x) OVER (PARTITION BY series_id ORDER BY t) AS y FROM rs) GROUP BY 1),
rw AS (SELECT series_id, t, avg(x) OVER w AS m, var_pop(x) OVER w AS v FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)),
dw AS (SELECT series_id, m, v, abs(m - lag(m, 128) OVER p) / sqrt(var) + abs(v - lag(v, 128) OVER p) / var AS d, var FROM rw JOIN bs USING (series_id) WHERE t >= 127 WINDOW p AS (PARTITION BY series_id ORDER BY t)),
dr AS (SELECT series_id, stddev_pop(m) / sqrt(any_value(var)) AS rolling_mean_drift, stddev_pop(v) / avg(v) AS rolling_variance_drift, max(d) AS regime_change_proxy, CASE WHEN count(d) > 0 THEN count(*) FILTER (WHERE d > 1) / count(d) END AS change_density_score FROM dw GROUP BY 1),
pr AS (
  SELECT bs.series_id, n, n - valid AS missing, (n - valid) / n AS nan_rate, 0 AS longest, 'none' AS pattern, 1 AS dimensions, valid, 1 AS valid_dimensions, kurtosis_proxy, outlier_rate_iqr, mad * 1.4826 / sqrt(var) AS mad_to_std_ratio, sqrt(var) AS std, mad * 1.4826 AS robust_std,
    x1.r AS lag1_autocorr, x8.r AS lagk_autocorr, dl.a AS pacf_lagk_proxy, r1.r AS residual_lag1_autocorr, rolling_mean_drift, rolling_variance_drift, coalesce(regime_change_proxy, 0) AS regime_change_proxy, coalesce(change_density_score, 0) AS change_density_score,
    false AS used_subsampling, bin >= 0.98 AS binary_like, cnt >= 0.98 AND bin < 0.98 AS count_like, d.period, coalesce(d.strength, 0) AS strength, trend, far, abs(ln(sqrt(var) / (1.4826 * mad))) AS ratio
  FROM bs JOIN mo USING (series_id) JOIN al x1 ON x1.series_id = bs.series_id AND x1.lag = 1 JOIN al x8 ON x8.series_id = bs.series_id AND x8.lag = 8 JOIN dl ON dl.series_id = bs.series_id AND dl.k = 8
    JOIN r1 ON r1.series_id = bs.series_id JOIN dr ON dr.series_id = bs.series_id LEFT JOIN d ON d.series_id = bs.series_id
)"""
_SHOWN = ", ".join(f"round({k}, 4) AS {k}" for k in P.MEASURES)
_SIGNALS = """, fl AS (
  SELECT *, n >= 100000 AS huge_n, n BETWEEN 1000 AND 99999 AS medium_n, lag1_autocorr >= 0.55 OR lagk_autocorr >= 0.45 OR residual_lag1_autocorr >= 0.40 AS autocorrelated,
    kurtosis_proxy >= 4 OR outlier_rate_iqr >= 0.02 OR mad_to_std_ratio <= 0.80 AS heavy_tail, change_density_score >= 0.35 OR regime_change_proxy >= 1.20 AS change_dense,
    change_density_score < 0.12 AND regime_change_proxy >= 0.80 AS few_strong_changes, pattern = 'block' OR nan_rate >= 0.10 AS masking_risk, change_density_score < 0.05 AND regime_change_proxy < 0.25 AS low_signal,
    greatest(lag1_autocorr / 0.55, lagk_autocorr / 0.45, residual_lag1_autocorr / 0.40) AS auto_score,
    greatest(kurtosis_proxy / 4, outlier_rate_iqr / 0.02, CASE WHEN mad_to_std_ratio <= 0.80 THEN 0.80 / greatest(mad_to_std_ratio, 1e-12) ELSE 0 END) AS tail_score FROM pr
), cf AS (SELECT *, (autocorrelated AND heavy_tail AND n < 1000) OR (low_signal AND (autocorrelated OR heavy_tail)) OR 2 * valid_dimensions < dimensions AS conflicting_signals FROM fl),
sg AS (
  SELECT series_id, 'binary_like' AS strongest, 2.0::DOUBLE AS sc, 8 AS pri FROM cf WHERE binary_like UNION ALL SELECT series_id, 'count_like', 1.8, 7 FROM cf WHERE count_like
  UNION ALL SELECT series_id, 'autocorrelated', auto_score, 6 FROM cf WHERE autocorrelated UNION ALL SELECT series_id, 'heavy_tail', tail_score, 5 FROM cf WHERE heavy_tail
  UNION ALL SELECT series_id, 'change_dense', greatest(change_density_score / 0.35, regime_change_proxy / 1.20), 4 FROM cf WHERE change_dense
  UNION ALL SELECT series_id, 'few_strong_changes', greatest(regime_change_proxy / 0.80, 1), 3 FROM cf WHERE few_strong_changes
  UNION ALL SELECT series_id, 'masking_risk', greatest(nan_rate / 0.10, 1), 2 FROM cf WHERE masking_risk
  UNION ALL SELECT series_id, 'low_signal', 1 + greatest(0.05 - change_density_score, 0) / 0.05 + greatest(0.25 - regime_change_proxy, 0) / 0.25, 1 FROM cf WHERE low_signal
), st AS (SELECT series_id, strongest FROM sg QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sc DESC, pri DESC) = 1)"""


def _scored(candidates: str, weights: tuple, axis: str, safe: str) -> str:
    """Scores of candidates (when, pipeline, speed, accuracy, robustness, base confidence, evidence, stand-in, signals)."""
    ranges = ", ".join(f"('{k}', {v[0]}, {v[1]}, " + ", ".join(f"{x[0]}, {x[1]}, {x[2]}" for x in v[2:]) + ")" for k, v in CALIBRATION.items())
    names = ", ".join(f"a{i}, z{i}, w{i}" for i in range(len(FEATURES)))
    outside = " + ".join(f"w{i} * least(greatest(a{i} - {f}, {f} - z{i}, 0) / greatest(z{i} - a{i}, 1e-9), 3)" for i, f in enumerate(FEATURES))
    weight = " + ".join(f"w{i}" for i in range(len(FEATURES)))
    return f""", ca(family, icept, slope, {names}) AS (VALUES {ranges}), fam AS (
  SELECT cf.*, strongest, CASE WHEN dimensions >= 4 THEN 'multivariate' WHEN binary_like THEN 'binary' WHEN count_like THEN 'count' WHEN strength >= 0.40 THEN 'seasonal'
    WHEN autocorrelated AND tail_score > auto_score + 0.25 THEN 'heavy_tailed' WHEN autocorrelated THEN 'autocorrelated' WHEN heavy_tail THEN 'heavy_tailed' ELSE 'gaussian' END AS calibration
  FROM cf LEFT JOIN st USING (series_id)
), od AS (SELECT fam.*, icept, slope, greatest(least(1 - exp(-0.9 * ({outside}) / ({weight})), 0.8), 0) AS ood FROM fam JOIN ca ON ca.family = fam.calibration),
cd AS ({candidates}), sc AS (
  SELECT cd.*, calibration, strongest, conflicting_signals, ood, {weights[0]} * speed + {weights[1]} * accuracy + {weights[2]} * robustness AS fit,
    greatest(least(base - CASE WHEN stand_in THEN 0.08 ELSE 0 END + CASE WHEN {axis} THEN 0.05 ELSE 0 END - CASE WHEN masking_risk THEN 0.07 ELSE 0 END - CASE WHEN conflicting_signals THEN 0.15 ELSE 0 END
      + CASE WHEN list_contains(signals, strongest) THEN 0.10 ELSE 0 END, 0.95), 0.05) AS raw,
    greatest(evidence - CASE WHEN stand_in THEN 0.05 ELSE 0 END - CASE WHEN conflicting_signals THEN 0.10 ELSE 0 END - CASE WHEN low_signal THEN 0.05 ELSE 0 END, 0) AS support, icept, slope
  FROM cd JOIN od USING (series_id)
), cn AS (SELECT *, greatest(least(greatest(least(icept + slope * raw, 0.99), 0.01) * (1 - ood), 0.99), 0.01) AS confidence FROM sc),
wi AS (SELECT *, greatest(least(0.10 + 0.25 * (1 - confidence) + CASE WHEN conflicting_signals THEN 0.05 ELSE 0 END + 0.20 * ood, 0.45), 0.08) AS half, 0.55 * fit + 0.35 * confidence + 0.10 * support AS score FROM cn),
rk AS (SELECT *, row_number() OVER w AS place, first(confidence) OVER w AS top FROM wi WINDOW w AS (PARTITION BY series_id ORDER BY score DESC, confidence DESC, pipeline))
SELECT series_id, place, pipeline, round(score, 4) AS score, round(confidence, 4) AS confidence, round(greatest(confidence - half, 0), 4) AS low, round(least(confidence + half, 1), 4) AS high, calibration, strongest, top < 0.2 AS abstained
FROM rk WHERE CASE WHEN top < 0.2 THEN pipeline LIKE '{safe}%' ELSE place <= 5 END"""


_RULE = "SELECT series_id, '{name}' AS pipeline, {speed} AS speed, {accuracy} AS accuracy, {robustness} AS robustness, {base} AS base, {evidence} AS evidence, {stand_in} AS stand_in, {signals} AS signals FROM cf WHERE {when}"


def _rules(*rows) -> str:
    keys = ("when", "name", "speed", "accuracy", "robustness", "base", "evidence", "stand_in", "signals")
    return " UNION ALL ".join(_RULE.format(**dict(zip(keys, r, strict=True))) for r in rows)


#: Series of at most 99,999 rows and one column: those of the comparison.
_OFFLINE = _rules(
    ("medium_n AND heavy_tail", "offline:binseg:l1_median:jump=1", 0.38, 0.74, 0.93, 0.74, 0.86, "false", "['heavy_tail']"),
    ("medium_n AND few_strong_changes AND masking_risk", "offline:wbs:normal:jump=1", 0.62, 0.84, 0.73, 0.74, 0.80, "false", "['few_strong_changes', 'masking_risk']"),
    ("medium_n AND few_strong_changes AND NOT masking_risk", "offline:binseg:normal:jump=1", 0.86, 0.70, 0.60, 0.74, 0.76, "false", "['few_strong_changes']"),
    ("medium_n AND change_dense", "offline:fpop:l2:jump=1", 0.92, 0.73, 0.55, 0.74, 0.70, "false", "['change_dense']"),
    ("medium_n AND change_dense", "offline:wbs:l2:jump=1", 0.66, 0.76, 0.58, 0.74, 0.66, "true", "['change_dense']"),
    ("NOT huge_n AND NOT medium_n", "offline:dynp:normal:jump=1", 0.55, 0.88, 0.60, 0.74, 0.76, "false", "['few_strong_changes']"),
    ("true", "offline:pelt:l2:jump=1", 0.90, 0.72, 0.55, 0.56, 0.42, "false", "['low_signal']"),
)
_ONLINE = _rules(
    ("binary_like", "online:bocpd:bernoulli:max_run_length=2000", 0.78, 0.84, 0.74, 0.74, 0.78, "false", "['binary_like']"),
    ("count_like AND NOT binary_like", "online:bocpd:poisson:max_run_length=2000", 0.76, 0.84, 0.74, 0.74, 0.76, "false", "['count_like']"),
    ("NOT count_like AND NOT binary_like", "online:bocpd:gaussian:max_run_length=2000", 0.74, 0.82, 0.72, 0.64, 0.62, "false", "['autocorrelated']"),
    ("true", "online:cusum", 0.95, 0.58, 0.48, 0.64, 0.55, "false", "['low_signal']"),
)

QUERIES = {
    "missing_overview": (missing_overview, f"WITH {BLOCKS}, i AS (SELECT series_id, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM g WHERE x IS NULL), r AS (SELECT series_id, max(n) AS longest FROM (SELECT series_id, k, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1), c AS (SELECT series_id, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS missing FROM g GROUP BY 1) SELECT series_id, n, missing, round(missing / n, 6) AS nan_rate, coalesce(longest, 0) AS longest, CASE WHEN missing = 0 THEN 'none' WHEN coalesce(longest, 0) >= greatest(8, ceil(missing / 4)) THEN 'block' ELSE 'random' END AS pattern FROM c LEFT JOIN r USING (series_id)"),
    "autocorrelations": (autocorrelations, _LAGS + " " + " UNION ALL ".join(_ACF.format(k=k) for k in (1, 2, 3, 7))),
    "pacf": (pacf, f"""WITH {EVENTS}, g AS (SELECT series_id, avg(x) AS m, var_pop(x) AS v FROM s GROUP BY 1), c AS (SELECT series_id, t, x - m AS c, v FROM s JOIN g USING (series_id)),
l AS (SELECT series_id, v, c, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3 FROM c WINDOW w AS (PARTITION BY series_id ORDER BY t)),
r AS (SELECT series_id, avg(c * c1) / any_value(v) AS r1, avg(c * c2) / any_value(v) AS r2, avg(c * c3) / any_value(v) AS r3 FROM l GROUP BY 1),
k AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS k2 FROM r)
SELECT series_id, 1 AS lag, round(r1, 6) AS pacf FROM k UNION ALL SELECT series_id, 2, round(k2, 6) FROM k
UNION ALL SELECT series_id, 3, round((r3 - (r1 - k2 * r1) * r2 - k2 * r1) / ((1 - r1 * r1) * (1 - k2 * k2)), 6) FROM k"""),
    "dominant_period": (dominant_period, f"WITH {EVENTS}{_PERIODS} SELECT series_id, period, round(strength, 6) AS strength FROM d"),
    "period_votes": (period_votes, f"WITH {USERS}{_PERIODS}, v AS (SELECT period, sum(strength) AS st FROM d GROUP BY 1) SELECT period, round(st, 5) AS strength, row_number() OVER (ORDER BY st DESC, period) AS place FROM v QUALIFY place <= 3"),
    "residual_lag1": (residual_lag1, f"WITH {EVENTS}, f AS (SELECT series_id, regr_slope(x, t) AS b, regr_intercept(x, t) AS a FROM s GROUP BY 1), r AS (SELECT s.series_id, t, x - a - b * t AS x FROM s JOIN f USING (series_id)), l AS (SELECT series_id, x, lag(x) OVER (PARTITION BY series_id ORDER BY t) AS y FROM r) SELECT series_id, round(corr(x, y), 5) AS residual_lag1_autocorr FROM l GROUP BY 1"),
    "shape": (shape, f"WITH {EVENTS}, m AS (SELECT series_id, avg(x) AS mu, median(x) AS med, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM s GROUP BY 1) SELECT s.series_id, count(*) AS valid, round(avg((x - mu) ^ 4) / avg((x - mu) ^ 2) ^ 2, 4) AS kurtosis_proxy, round(count(*) FILTER (WHERE x < lo - 1.5 * (hi - lo) OR x > hi + 1.5 * (hi - lo)) / count(*), 6) AS outlier_rate_iqr, round(median(abs(x - med)) * 1.4826 / stddev_pop(x), 5) AS mad_to_std_ratio FROM s JOIN m USING (series_id) GROUP BY 1"),
    "drift": (drift, f"""WITH {EVENTS}, r AS (SELECT series_id, t, avg(x) OVER w AS m, var_pop(x) OVER w AS v FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)),
l AS (SELECT series_id, m, v, lag(m, 128) OVER p AS pm, lag(v, 128) OVER p AS pv FROM r WHERE t >= 127 WINDOW p AS (PARTITION BY series_id ORDER BY t)), g AS (SELECT series_id, var_pop(x) AS var FROM s GROUP BY 1),
q AS (SELECT l.*, var, abs(m - pm) / sqrt(var) + abs(v - pv) / var AS d FROM l JOIN g USING (series_id)),
o AS (SELECT series_id, stddev_pop(m) / sqrt(any_value(var)) AS a, stddev_pop(v) / avg(v) AS b, max(d) AS c, count(*) FILTER (WHERE d > 1) / count(d) AS e FROM q GROUP BY 1)
SELECT series_id, round(coalesce(a, 0), 4) AS rolling_mean_drift, round(coalesce(b, 0), 4) AS rolling_variance_drift, round(coalesce(c, 0), 4) AS regime_change_proxy, round(coalesce(e, 0), 4) AS change_density_score FROM g LEFT JOIN o USING (series_id)"""),
    "hints": (hints, _HINTS),
    "diagnostics": (diagnostics, f"{_PROFILE} SELECT series_id, n, missing, round(nan_rate, 6) AS nan_rate, longest, pattern, dimensions, valid, valid_dimensions, {_SHOWN}, used_subsampling, binary_like, count_like, period, round(strength, 6) AS strength FROM pr"),
    "diagnostics_gaps": (diagnostics_gaps, _GAPS),
    "signal_flags": (signal_flags, f"{_PROFILE}{_SIGNALS} SELECT series_id, huge_n, medium_n, autocorrelated, heavy_tail, change_dense, few_strong_changes, masking_risk, low_signal, conflicting_signals, strongest FROM cf LEFT JOIN st USING (series_id)"),
    "preprocessing_advice": (preprocessing_advice, f"{_PROFILE}, se AS (SELECT al.series_id, lag, abs(r) AS strength FROM al JOIN bs USING (series_id) WHERE lag >= 2 AND lag <= least(128, n // 4) QUALIFY row_number() OVER (PARTITION BY al.series_id ORDER BY abs(r) DESC, lag) = 1) SELECT series_id, trend >= 0.25 AS detrend, CASE WHEN se.strength >= 0.35 THEN lag END AS difference_by, far >= 0.02 AS winsorize, ratio >= 0.35 AS robust_scale, round(trend, 5) AS trend_strength, round(se.strength, 5) AS seasonality_strength, lag AS best_lag, round(far, 5) AS outlier_rate, round(ratio, 5) AS scale_instability FROM pr JOIN se USING (series_id)"),
    "recommendations": (recommendations, _PROFILE + _SIGNALS + _scored(_OFFLINE, (0.34, 0.33, 0.33), "false", "offline:pelt:l2:")),
    "recommendations_online": (recommendations_online, _PROFILE + _SIGNALS + _scored(_ONLINE, (0.60, 0.20, 0.20), "speed >= accuracy AND speed >= robustness", "online:bocpd:gaussian:")),
    "pipeline_spec": (pipeline_spec, None),
    "ensemble": (consensus, None),
    "validate": (validation, None),
    "sql_function": (sql_function, f"WITH q AS ({_optimal(USERS, _L2, 5, '9000::DOUBLE')}) SELECT series_id AS who, CAST(unnest(string_split(change_points, ',')) AS BIGINT) AS change_point FROM q WHERE change_points <> ''"),
}
