"""Metrics of change points and alerts against a stand-in truth: multiples of 20 rows for each user's series.

Some users have no true points, some no found ones and some neither, so that the rules of empty sides are met."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import generate as G
from ..operators import splits as S
from ..sources import tables as T
from .base import USERS
from .detectors import _scores


def _frames(spark, d):
    s = T.events(spark, d, "user_id")
    n = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    user = F.col("series_id").cast("long")
    truth = s.where((F.col("t") > 0) & (F.col("t") % 20 == 0) & (user % 7 != 3)).select("series_id", F.col("t").alias("cp"))
    found = S.ranked(S.window_scores(s, 10), 3).where(user % 5 != 2).select("series_id", F.col("split").alias("cp"))
    return s, n, truth, found


def f1(spark, d):
    _, n, truth, found = _frames(spark, d)
    r = lambda c: F.round(c, 6).alias(c)
    return E.f1(truth, found, n, 2).select("series_id", r("precision"), r("recall"), r("f1"))


def hausdorff(spark, d):
    _, n, truth, found = _frames(spark, d)
    return E.hausdorff(truth, found, n)


def annotation_error(spark, d):
    _, n, truth, found = _frames(spark, d)
    return E.annotation_error(truth, found, n).select("series_id", F.round("annotation_error", 6).alias("annotation_error"))


def rand_index(spark, d):
    _, n, truth, found = _frames(spark, d)
    return E.rand_index(truth, found, n).select("series_id", F.round("rand_index", 6).alias("rand_index"))


def offline_metrics(spark, d):
    _, n, truth, found = _frames(spark, d)
    r = lambda c: F.round(c, 6).alias(c)
    return E.offline_metrics(truth, found, n, 2).select("series_id", r("precision"), r("recall"), r("f1"), "hausdorff", r("rand_index"), r("annotation_error"))


def _steps(s):
    return s.select("series_id", "t", (F.col("x_fp") > 9000).alias("alert"), F.least(F.floor(F.col("x_fp") / 1000) / 20, F.lit(1.0)).alias("p_change"))


def online_metrics(spark, d):
    s, _, truth, _ = _frames(spark, d)
    out = E.online_metrics(_steps(s), truth)
    return out.select("series_id", "detected", "missed", F.round("mean_delay", 6).alias("mean_delay"), "false_alarms", F.round("false_alarm_rate", 6).alias("false_alarm_rate"), F.round("arl0", 6).alias("arl0"))


def roc(spark, d):
    s, _, truth, _ = _frames(spark, d)
    out = E.roc(_steps(s), truth)
    return out.select("series_id", F.round("threshold", 6).alias("threshold"), "detected", "false_alerts", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def calibration(spark, d):
    s = T.events(spark, d)
    p = s.select(F.col("series_id").alias("family"), F.least(F.floor(F.col("x_fp") / 100) / 512, F.lit(1.0)).alias("confidence"), (F.col("t") % 3 == 0).cast("double").alias("correct"))
    return E.calibration(p).select("family", F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"), "n")


def even_change_points(spark, d):
    return spark.createDataFrame([(k, c) for k in range(1, 6) for c in G.even_change_points(300, k)], "k bigint, cp bigint")


def generated(spark, d):
    """Every kind of generator: rows and finite values."""
    out = None
    for kind in ("mean", "variance", "linear", "ar1", "heavy_tail", "poisson", "bernoulli"):
        g = G.generate(spark, kind, series=2, n=120).groupBy("series_id").agg(F.count("x").alias("n"), F.count_if(F.isnan("x")).alias("nan"))
        g = g.select(F.lit(kind).alias("kind"), "series_id", "n", "nan")
        out = g if out is None else out.unionByName(g)
    return out


_T = f"""WITH {USERS}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), tr AS (SELECT series_id, t AS cp FROM s WHERE t > 0 AND t % 20 = 0 AND CAST(series_id AS BIGINT) % 7 <> 3)"""
_F = _scores(USERS, 5).replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), tr AS (SELECT series_id, t AS cp FROM s WHERE t > 0 AND t % 20 = 0 AND CAST(series_id AS BIGINT) % 7 <> 3),
fd AS (SELECT series_id, split AS cp FROM q WHERE CAST(series_id AS BIGINT) % 5 <> 2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY score DESC, split) <= 3)"""
_MATCH = """, arr AS (
  SELECT n.series_id, coalesce((SELECT list(cp ORDER BY cp) FROM tr WHERE tr.series_id = n.series_id), []) AS a, coalesce((SELECT list(cp ORDER BY cp) FROM fd WHERE fd.series_id = n.series_id), []) AS b FROM n
), m AS (
  SELECT series_id, a, b, 1::BIGINT AS i, 1::BIGINT AS j, 0::BIGINT AS hits FROM arr
  UNION ALL
  SELECT series_id, a, b, CASE WHEN abs(a[i] - b[j]) <= 2 OR a[i] < b[j] THEN i + 1 ELSE i END, CASE WHEN abs(a[i] - b[j]) <= 2 OR a[i] >= b[j] THEN j + 1 ELSE j END, hits + CASE WHEN abs(a[i] - b[j]) <= 2 THEN 1 ELSE 0 END
  FROM m WHERE i <= len(a) AND j <= len(b)
), h AS (SELECT series_id, max(hits) AS h, any_value(len(a)) AS na, any_value(len(b)) AS nb FROM m GROUP BY 1), pr AS (
  SELECT series_id, na, nb, CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN nb = 0 THEN 0 ELSE h / nb END AS p, CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 THEN 0 ELSE h / na END AS r FROM h
), fs AS (SELECT series_id, na, nb, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr)"""
_NEAR = """, ab AS (SELECT a.series_id, a.cp, min(abs(a.cp - b.cp)) AS d FROM tr a JOIN fd b ON a.series_id = b.series_id GROUP BY 1, 2),
ba AS (SELECT a.series_id, a.cp, min(abs(a.cp - b.cp)) AS d FROM fd a JOIN tr b ON a.series_id = b.series_id GROUP BY 1, 2),
hd AS (SELECT series_id, CASE WHEN na = 0 AND nb = 0 THEN 0 WHEN na = 0 OR nb = 0 THEN NULL ELSE greatest((SELECT max(d) FROM ab WHERE ab.series_id = fs.series_id), (SELECT max(d) FROM ba WHERE ba.series_id = fs.series_id)) END AS hausdorff,
  CASE WHEN nb = 0 THEN 0 WHEN na = 0 THEN NULL ELSE round((SELECT avg(d) FROM ba WHERE ba.series_id = fs.series_id), 6) END AS annotation_error FROM fs)"""
_RAND = """, lab AS (
  SELECT s.series_id, s.t, (SELECT count(*) FROM tr WHERE tr.series_id = s.series_id AND tr.cp <= s.t) AS a, (SELECT count(*) FROM fd WHERE fd.series_id = s.series_id AND fd.cp <= s.t) AS b FROM s
), ri AS (SELECT x.series_id, avg(CASE WHEN (x.a = y.a) = (x.b = y.b) THEN 1 ELSE 0 END) AS r FROM lab x JOIN lab y ON x.series_id = y.series_id AND x.t < y.t GROUP BY 1)"""

QUERIES = {
    "eval_f1": (f1, _F + _MATCH + " SELECT series_id, precision, recall, f1 FROM fs"),
    "eval_hausdorff": (hausdorff, _F + _MATCH + _NEAR + " SELECT series_id, hausdorff FROM hd"),
    "eval_annotation_error": (annotation_error, _F + _MATCH + _NEAR + " SELECT series_id, annotation_error FROM hd"),
    "eval_rand_index": (rand_index, _F + _RAND + " SELECT series_id, round(r, 6) AS rand_index FROM ri"),
    "eval_offline_metrics": (offline_metrics, _F + _MATCH + _NEAR + _RAND + " SELECT series_id, precision, recall, f1, hausdorff, round(r, 6) AS rand_index, annotation_error FROM fs JOIN hd USING (series_id) JOIN ri USING (series_id)"),
    "eval_online_metrics": (online_metrics, _T + """, al AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS pos, x_fp > 9000 AS alert FROM s), o AS (SELECT al.series_id, al.t, al.pos, max(tr.cp) AS cp FROM al LEFT JOIN tr ON tr.series_id = al.series_id AND tr.cp <= al.t WHERE alert GROUP BY 1, 2, 3),
h AS (SELECT *, cp IS NOT NULL AND row_number() OVER (PARTITION BY series_id, cp ORDER BY t) = 1 AS hit FROM o), g AS (SELECT series_id, count(*) FILTER (WHERE hit) AS detected, count(*) FILTER (WHERE NOT hit) AS fa, avg(t - cp) FILTER (WHERE hit) AS d, max(pos) FILTER (WHERE NOT hit) AS last FROM h GROUP BY 1), k AS (SELECT series_id, count(*) AS k FROM tr GROUP BY 1)
SELECT n.series_id, coalesce(detected, 0) AS detected, coalesce(k, 0) - coalesce(detected, 0) AS missed, round(d, 6) AS mean_delay, coalesce(fa, 0) AS false_alarms, round(coalesce(fa, 0) / n, 6) AS false_alarm_rate, round(CASE WHEN fa > 0 THEN (last + 1) / fa ELSE 'infinity'::DOUBLE END, 6) AS arl0 FROM n LEFT JOIN g USING (series_id) LEFT JOIN k USING (series_id)"""),
    "eval_roc": (roc, _T + """, p AS (SELECT series_id, t, least((x_fp // 1000) / 20, 1) AS p, (SELECT count(*) FROM tr WHERE tr.series_id = s.series_id AND tr.cp <= s.t) AS w FROM s), th AS (SELECT DISTINCT series_id, p AS th FROM p UNION SELECT series_id, max(p) + 1 FROM p GROUP BY 1 UNION SELECT series_id, min(p) - 1 FROM p GROUP BY 1),
c AS (SELECT th.series_id, th, count(*) FILTER (WHERE p >= th) AS alerts, count(DISTINCT w) FILTER (WHERE p >= th AND w > 0) AS detected, count(*) AS n, max(w) AS changes FROM th JOIN p USING (series_id) GROUP BY 1, 2)
SELECT series_id, round(th, 6) AS threshold, detected, alerts - detected AS false_alerts, round(CASE WHEN changes = 0 THEN 1 ELSE detected / changes END, 6) AS tpr, round((alerts - detected) / (n - changes), 6) AS fpr FROM c"""),
    "eval_calibration": (calibration, """WITH s AS (SELECT event_type AS family, least((CAST(round(value * 100) AS BIGINT) // 100) / 512, 1) AS c, CASE WHEN (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ok FROM events),
b AS (SELECT family, least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS c, avg(ok) AS a, sum((c - ok) ^ 2) AS sq FROM s GROUP BY GROUPING SETS ((1, 2), (2)))
SELECT family, round(sum(n * abs(c - a)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier, sum(n)::BIGINT AS n FROM b GROUP BY 1"""),
    "even_change_points": (even_change_points, "SELECT k, i * 300 // (k + 1) AS cp FROM range(1, 6) a(k), range(1, 6) b(i) WHERE i <= k"),
    "generated": (generated, "SELECT kind, CAST(i AS VARCHAR) AS series_id, 120 AS n, 0 AS nan FROM (VALUES ('mean'), ('variance'), ('linear'), ('ar1'), ('heavy_tail'), ('poisson'), ('bernoulli')) v(kind), range(2) r(i)"),
}
