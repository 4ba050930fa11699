"""Splits, offline detectors and online detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AlertPolicy
from ..functions.cost_kernels import VAR_FLOOR
from ..functions.scan import CHUNK
from ..operators import detect as D
from ..operators import online as O
from ..operators import splits as S
from ..sources import tables as T
from .base import ERRORS, EVENTS, LINEITEM, USERS

#: What a split of a series of events must gain.
BETA = 10000.0


def best_split_l2(spark, d):
    return S.best_split(T.events(spark, d))


def best_split_l2_users(spark, d):
    return S.best_split(T.events(spark, d, "user_id"), 5)


def best_split_l2_long(spark, d):
    """The same for series longer than a task should hold: numbered by ranges, summed by chunks."""
    return S.best_split(T.events(spark, d, long=True), chunk=512)


def best_split_lineitem(spark, d):
    """All line items as one series."""
    return S.best_split(T.lineitem_rows(spark, d), chunk=CHUNK, digits=2)


def binseg_levels(spark, d):
    """To a greatest depth of 3, which is a setting of the method."""
    return S.binseg_levels(T.events(spark, d, long=True), beta=BETA, levels=3, chunk=CHUNK)


def window_scores(spark, d):
    return S.window_scores(T.events(spark, d))


def window_peaks(spark, d):
    return S.local_peaks(S.window_scores(T.events(spark, d)))


def window_top_k(spark, d):
    return S.ranked(S.window_scores(T.events(spark, d, "user_id"), 10), 3).select("series_id", "split", "score", "place")


def wbs_grid(spark, d):
    return S.dyadic_intervals(T.events(spark, d, "user_id"))


def wbs_grid_best(spark, d):
    return S.frontier_argmax(S.dyadic_best_splits(T.events(spark, d, "user_id")))


def wbs_plan(spark, d):
    """Wild binary segmentation to the end, on an even choice of the grid's intervals."""
    return S.wbs(T.events(spark, d), BETA)


def _points(results):
    return results.select("series_id", "n", F.round("objective", 1).alias("objective"), F.array_join("change_points", ",").alias("change_points"))


def _hundredths(s):
    """Values as whole hundredths, whose sums are exact, so that segmentations that tie do so as in the SQL; to be scaled by 100."""
    return s.withColumn("x", F.col("x_fp").cast("double"))


def pelt_l2(spark, d):
    return _points(D.detect_series(_hundredths(T.events(spark, d, "user_id")), "pelt", "l2", cost_options={"scale": 100.0}))


def pelt_normal(spark, d):
    return _points(D.detect_series(T.events(spark, d, "user_id"), "pelt", "normal"))


def fpop_l2(spark, d):
    return _points(D.detect_series(_hundredths(T.events(spark, d, "user_id")), "fpop", "l2", cost_options={"scale": 100.0}))


def pelt_manual_jump(spark, d):
    """With a penalty and a jump given by hand; a jump of 1 tries every row as a change point."""
    return _points(D.detect_series(T.events(spark, d, "user_id"), "pelt", "l2", {"pen": 9000.0}, {"min_segment_len": 4, "jump": 1}))


def pelt_bernoulli(spark, d):
    return _points(D.detect_series(T.error_flags(spark, d), "pelt", "bernoulli"))


def dynp_k1(spark, d):
    return _points(D.detect_series(T.events(spark, d, "user_id"), "dynp", "l2", {"k": 1}))


def dynp_k2(spark, d):
    return _points(D.detect_series(T.events(spark, d, "user_id"), "segneigh", "l2", {"k": 2}))


def kernel_linear_k1(spark, d):
    """The linear kernel's scatter is the L2 cost."""
    return _points(D.detect_series(T.events(spark, d, "user_id"), "kernel", "l2", {"k": 1}, options={"kernel": "linear"}))


def binseg_l2_k1(spark, d):
    return _points(D.detect_series(T.events(spark, d, "user_id"), "binseg", "l2", {"k": 1}))


def window_l2_k1(spark, d):
    return _points(D.detect_series(T.events(spark, d, "user_id"), "window", "l2", {"k": 1}, options={"width": 10}))


def _plain(detector, cost="l2", stopping=None, rows="user_id", **more):
    def run(spark, d):
        s = T.error_flags(spark, d) if rows == "flags" else T.orders_daily(spark, d) if rows == "orders" else T.lineitem_daily(spark, d) if rows == "lineitem" else T.events(spark, d, rows)
        return _points(D.detect_series(s, detector, cost, stopping, **more))

    return run


def segment_stats(spark, d):
    s = T.events(spark, d, "user_id")
    out = D.segment_stats(s, D.detect_series(s, "dynp", "l2", {"k": 1}))
    return out.select("series_id", "seg_idx", "start", "end", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "count", "missing_count")


def cusum(spark, d):
    return O.cusum(T.events(spark, d, long=True), drift=5.0, threshold=400.0, target=50.0, chunk=CHUNK).select("series_id", "t", F.round("score", 6).alias("score"), F.round("p_change", 6).alias("p_change"))


def cusum_lineitem(spark, d):
    """All line items as one series."""
    return O.cusum(T.lineitem_rows(spark, d), drift=0.5, threshold=400.0, target=25.5, chunk=CHUNK).select("series_id", "t", F.round("score", 6).alias("score"), F.round("p_change", 6).alias("p_change"))


def page_hinkley(spark, d):
    return O.page_hinkley(T.events(spark, d, long=True), delta=0.5, threshold=400.0, chunk=CHUNK).select("series_id", "t", F.round("score", 5).alias("score"), F.round("p_change", 6).alias("p_change"))


def alert_gate(spark, d):
    p = O.cusum(T.events(spark, d, "user_id"), drift=5.0, threshold=200.0, target=50.0)
    return O.alert_gate(p, AlertPolicy(0.8, 3, 0.3, 5)).select("series_id", "t", F.round("p_change", 6).alias("p_change"))


def cusum_steps(spark, d):
    return O.run_online(T.events(spark, d, "user_id"), "cusum", drift=5.0, threshold=200.0, target=50.0).select("series_id", "t", F.round("p_change", 6).alias("p_change"))


def bocpd_bernoulli(spark, d):
    return O.run_online(T.error_flags(spark, d), "bocpd", model="bernoulli").select("series_id", "t", F.round("p_change", 6).alias("p_change"), F.round("run_length_mean", 4).alias("run_length_mean"))


def bocpd_gaussian(spark, d):
    return O.run_online(T.events(spark, d, "user_id"), "bocpd", model="gaussian").select("series_id", "t", F.round("p_change", 6).alias("p_change"), "run_length_mode", F.round("run_length_mean", 4).alias("run_length_mean"))


def bocpd_poisson(spark, d):
    return O.run_online(T.orders_daily(spark, d), "bocpd", model="poisson", hazard={"mean_run_length": 250}).select("series_id", "t", F.round("p_change", 6).alias("p_change"), F.round("run_length_mean", 3).alias("run_length_mean"))


def _arrivals(spark, d):
    """Rows of a user in an arrival order in which every fifth row comes two places late."""
    s = T.events(spark, d, "user_id").withColumn("t_ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    return s.withColumn("arrival_seq", F.when(F.col("t") % 5 == 1, 10 * F.col("t") + 25).otherwise(10 * F.col("t")))


def late_rows(spark, d):
    return O.late_counters(_arrivals(spark, d))


def watermarks(spark, d):
    return O.watermark(_arrivals(spark, d)).select("series_id", "t", "watermark")


def late_reorder(spark, d):
    """CUSUM over the late rows, reordered; late rows repeat the step before them."""
    from ..config import LatePolicy

    late = LatePolicy("reorder", 10**18, 8, "drop_oldest")
    return O.run_online(_arrivals(spark, d), "cusum", order="arrival_seq", drift=5.0, threshold=200.0, target=50.0, late=late)


_GAIN = """, w AS (
  SELECT series_id, t, {ts} sum(x_fp) OVER p - x_fp AS l, sum(x_fp) OVER q AS a, count(*) OVER q AS n FROM s
  WINDOW p AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY series_id)
), c AS (
  SELECT *, round((l::DOUBLE * l / t + (a - l)::DOUBLE * (a - l) / (n - t) - a::DOUBLE * a / n) / 10000, 6) AS gain FROM w WHERE t >= {m} AND n - t >= {m}
), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY gain DESC, t) AS k FROM c)
"""
_BEST = f"WITH {EVENTS}" + _GAIN.format(ts="ts,", m=2) + "SELECT series_id, n, t AS split, gain, ts AS ts_at_split FROM r WHERE k = 1"


_PREFIX = "p AS (SELECT series_id, t + 1 AS t, (sum(x_fp) OVER (PARTITION BY series_id ORDER BY t))::BIGINT AS v FROM s UNION ALL SELECT DISTINCT series_id, 0, 0 FROM s)"
_L2_GAIN = "round(((p.v - b.v)::DOUBLE * (p.v - b.v) / (p.t - {s}) + (z.v - p.v)::DOUBLE * (z.v - p.v) / ({e} - p.t) - (z.v - b.v)::DOUBLE * (z.v - b.v) / ({e} - {s})) / 10000, 6)"
_BINSEG = f"""WITH RECURSIVE {EVENTS}, {_PREFIX}, f AS (
  SELECT series_id, 0::BIGINT AS s, count(*) AS e, 0 AS depth, NULL::BIGINT AS split, NULL::DOUBLE AS gain, true AS open FROM s GROUP BY 1
  UNION ALL
  SELECT series_id, unnest([s, cut, s]), unnest([cut, e, e]), depth + 1, cut, gained, unnest([true, true, false]) FROM (
    SELECT f.series_id, f.s, f.e, f.depth, p.t AS cut, {_L2_GAIN.format(s="f.s", e="f.e")} AS gained
    FROM f JOIN p ON p.series_id = f.series_id AND p.t >= f.s + 2 AND p.t <= f.e - 2
    JOIN p b ON b.series_id = f.series_id AND b.t = f.s JOIN p z ON z.series_id = f.series_id AND z.t = f.e WHERE f.open AND f.depth < 3
    QUALIFY row_number() OVER (PARTITION BY f.series_id, f.s, f.e ORDER BY gained DESC, p.t) = 1 AND gained > {BETA}
  )
) SELECT series_id, split AS change_point, depth - 1 AS depth, gain FROM f WHERE NOT open"""


def _scores(cte: str, h: int) -> str:
    return f"""WITH {cte}, {_PREFIX}, d AS (
  SELECT series_id, t, (v - lag(v, {h}) OVER w)::DOUBLE AS l, (lead(v, {h}) OVER w - v)::DOUBLE AS r FROM p WINDOW w AS (PARTITION BY series_id ORDER BY t)
), q AS (SELECT series_id, t AS split, round((l * l / {h} + r * r / {h} - (l + r) * (l + r) / {2 * h}) / 10000, 6) AS score FROM d WHERE l IS NOT NULL AND r IS NOT NULL)"""


def _grid(cte: str) -> str:
    return f"""WITH RECURSIVE {cte}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), z AS (
  SELECT series_id, n, n AS size FROM n WHERE n >= 4 UNION ALL SELECT series_id, n, greatest(size // 2, 4) FROM z WHERE size > 4
), i AS (
  SELECT DISTINCT series_id, n, size, unnest(list_append(range(0, n - size + 1, greatest(size // 2, 1)), n - size)) AS s FROM z
)"""


_GRID = _grid(USERS)
_IN = "SELECT i.series_id, i.s, i.s + size AS e, p.t AS split, " + _L2_GAIN.format(s="i.s", e="(i.s + size)") + " AS gain FROM {i} i JOIN p ON p.series_id = i.series_id AND p.t >= i.s + 2 AND p.t <= i.s + size - 2 JOIN p b ON b.series_id = i.series_id AND b.t = i.s JOIN p z ON z.series_id = i.series_id AND z.t = i.s + size"
_WBS = f"""{_grid(EVENTS)}, {_PREFIX}, h AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY size, s) - 1 AS seen, count(*) OVER (PARTITION BY series_id) AS every, greatest(100, ceil(5 * sqrt(n)))::BIGINT AS goal FROM i
), k AS (SELECT * FROM h WHERE every <= goal OR (seen + 1) * goal // every > seen * goal // every),
pm AS MATERIALIZED (SELECT * FROM p), hb AS MATERIALIZED (SELECT k.series_id, k.s, k.s + size AS e, b.v AS bv, z.v AS zv FROM k JOIN pm b ON b.series_id = k.series_id AND b.t = k.s JOIN pm z ON z.series_id = k.series_id AND z.t = k.s + size),
w AS (SELECT hb.series_id, s, e, pm.t AS split, round(((v - bv)::DOUBLE * (v - bv) / (pm.t - s) + (zv - v)::DOUBLE * (zv - v) / (e - pm.t) - (zv - bv)::DOUBLE * (zv - bv) / (e - s)) / 10000, 6) AS gain FROM hb JOIN pm ON pm.series_id = hb.series_id AND pm.t >= s + 2 AND pm.t <= e - 2),
v AS MATERIALIZED (SELECT series_id, s, e, max(gain) AS gain, min(split) FILTER (WHERE gain = top) AS split FROM (SELECT *, max(gain) OVER (PARTITION BY series_id, s, e) AS top FROM w) GROUP BY 1, 2, 3),
f AS (
  SELECT series_id, 0::BIGINT AS s, n AS e, 0 AS depth, NULL::BIGINT AS split, NULL::DOUBLE AS gain, true AS open FROM n
  UNION ALL
  SELECT series_id, unnest([s, split, s]), unnest([split, e, e]), depth + 1, split, gain, unnest([true, true, false]) FROM (
    SELECT f.series_id, f.s, f.e, f.depth, v.split, v.gain FROM f JOIN v ON v.series_id = f.series_id AND v.s >= f.s AND v.e <= f.e WHERE f.open
    QUALIFY row_number() OVER (PARTITION BY f.series_id, f.s, f.e ORDER BY v.gain DESC, v.split, v.s) = 1 AND v.gain > {BETA}
  )
) SELECT series_id, split AS change_point, depth - 1 AS depth, gain FROM f WHERE NOT open"""


def _optimal(cte: str, cost: str, m: int, beta: str, where: str = "true", jump: int = 1) -> str:
    """Optimal partitioning by a recursion that carries the best objectives and starts of all prefixes as lists."""
    only = f"(dp.t + 1 < n AND (dp.t + 1) % {jump} <> 0) OR " if jump > 1 else ""
    starts = f"list_filter(range(0, dp.t + 2 - {m}), lambda k: k % {jump} = 0)" if jump > 1 else f"range(0, dp.t + 2 - {m})"
    place = f"(list_position(c, list_min(c)) - 1) * {jump}"
    return f"""WITH RECURSIVE {cte}, arr AS (
  SELECT series_id, count(*) AS n, list_prepend(0::DOUBLE, list(a ORDER BY t)) AS a, list_prepend(0::DOUBLE, list(b ORDER BY t)) AS b FROM (
    SELECT series_id, t, sum(x_fp::DOUBLE) OVER w AS a, sum(x_fp::DOUBLE * x_fp) OVER w AS b FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)) GROUP BY 1
), pen AS (SELECT *, {beta} AS beta FROM arr WHERE {where}), dp AS (
  SELECT series_id, 0::BIGINT AS t, [-beta] AS f, [0::BIGINT] AS p FROM pen
  UNION ALL
  SELECT series_id, t, list_append(f, CASE WHEN c IS NULL THEN 1e300 ELSE list_min(c) END), list_append(p, CASE WHEN c IS NULL THEN 0 ELSE {place} END) FROM (
    SELECT dp.series_id, dp.t + 1 AS t, f, p, CASE WHEN {only}dp.t + 1 < {m} OR (dp.t + 1 < n AND n - dp.t - 1 < {m}) THEN NULL
      ELSE list_transform({starts}, lambda k: f[k + 1] + {cost} + beta) END AS c
    FROM dp JOIN pen ON pen.series_id = dp.series_id WHERE dp.t < n)
), done AS (SELECT dp.series_id, n, f[n + 1] AS objective, p FROM dp JOIN pen ON pen.series_id = dp.series_id AND dp.t = n), back AS (
  SELECT series_id, n, objective, p, p[n + 1] AS pos, []::BIGINT[] AS cps FROM done
  UNION ALL SELECT series_id, n, objective, p, p[pos + 1], list_prepend(pos, cps) FROM back WHERE pos > 0
) SELECT series_id, n, round(objective, 1) AS objective, array_to_string(cps, ',') AS change_points FROM back WHERE pos = 0"""


_M = "(dp.t + 1 - k)"
_A, _B = "(a[dp.t + 2] - a[k + 1])", "(b[dp.t + 2] - b[k + 1])"
_L2 = f"greatest({_B} - {_A} * {_A} / {_M}, 0) / 10000"
_NORMAL = f"{_M} * ln(greatest(({_B} / {_M} - ({_A} / {_M}) * ({_A} / {_M})) / 10000, {VAR_FLOOR!r}))"
_BERN = f"CASE WHEN {_A} > 0 AND {_A} < {_M} THEN -({_A} * ln({_A} / {_M}) + ({_M} - {_A}) * ln(1 - {_A} / {_M})) ELSE 0 END"
_K1 = f"WITH {USERS}" + _GAIN.format(ts="", m=2).replace("), r AS", "), tot AS (SELECT series_id, sum(x_fp::DOUBLE * x_fp) - sum(x_fp)::DOUBLE * sum(x_fp) / count(*) AS sse FROM s GROUP BY 1), r AS") + "SELECT r.series_id, n, round(sse / 10000 - gain, 1) AS objective, CAST(t AS VARCHAR) AS change_points FROM r JOIN tot USING (series_id) WHERE k = 1"
_K2 = f"""WITH {USERS}, {_PREFIX}, q AS (SELECT series_id, sum(x_fp::DOUBLE * x_fp) AS b, count(*) AS n, sum(x_fp)::DOUBLE AS v FROM s GROUP BY 1), c AS (
  SELECT q.series_id, q.n, x.t AS i, y.t AS j, (b - x.v::DOUBLE * x.v / x.t - (y.v - x.v)::DOUBLE * (y.v - x.v) / (y.t - x.t) - (q.v - y.v) * (q.v - y.v) / (n - y.t)) / 10000 AS o
  FROM q JOIN p x ON x.series_id = q.series_id AND x.t >= 2 JOIN p y ON y.series_id = q.series_id AND y.t >= x.t + 2 AND y.t <= n - 2
) SELECT series_id, n, round(o, 1) AS objective, i || ',' || j AS change_points FROM c QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY o, j, i) = 1"""
_CUSUM = """, c AS (SELECT series_id, t, sum(x_fp - {k}) OVER (PARTITION BY series_id ORDER BY t) AS c FROM s),
z AS (SELECT series_id, t, (c - least(0, min(c) OVER (PARTITION BY series_id ORDER BY t)))::DOUBLE / 100 AS score FROM c)"""
_GATE = f"""WITH RECURSIVE {USERS}{_CUSUM.format(k=5500)}, p AS (SELECT series_id, t, least(score / 200, 1) AS p FROM z), g AS (
  SELECT series_id, -1::BIGINT AS t, true AS armed, NULL::BIGINT AS last, false AS fired, 0::DOUBLE AS p FROM (SELECT DISTINCT series_id FROM s)
  UNION ALL
  SELECT series_id, t, CASE WHEN fire THEN false ELSE armed END, CASE WHEN fire THEN t ELSE last END, fire, p FROM (
    SELECT *, p >= 0.8 AND armed AND (last IS NULL OR t - last >= 3) AND t + 1 >= 5 AS fire FROM (
      SELECT p.series_id, p.t, (g.armed OR p.p < 0.8::DOUBLE - 0.3::DOUBLE) AS armed, g.last, p.p FROM g JOIN p ON p.series_id = g.series_id AND p.t = g.t + 1))
) SELECT series_id, t, round(p, 6) AS p_change FROM g WHERE fired"""


def _predictive(model: str, x: str, n: str, k: str, q: str) -> str:
    """The log predictive of x after n values with the sum k and the sum of squares q, by the priors of the kernels."""
    if model == "bernoulli":
        return f"ln((CASE WHEN {x} = 1 THEN 1 + {k} ELSE 1 + {n} - {k} END) / (2 + {n}))"
    square = f"CASE WHEN {n} > 0 THEN {k} * {k} / {n} ELSE 0 END"
    a, b = f"(1 + {n} / 2)", f"(1 + 0.5 * greatest({q} - {square}, 0) + ({square}) / (2 * ({n} + 1)))"
    spread = f"(2 * {b} * ({n} + 2) / ({n} + 1))"  # degrees of freedom times the squared scale
    return f"(lgamma({a} + 0.5) - lgamma({a}) - 0.5 * ln(pi() * {spread}) - ({a} + 0.5) * ln(1 + ({x} - {k} / ({n} + 1)) ^ 2 / {spread}))"


def _bocpd(cte: str, rate: str, model: str, value: str = "x_fp", mode: str = "") -> str:
    """The run-length posterior by a recursion over lists of log probabilities, counts, sums and sums of squares."""
    after = _predictive(model, "x.x", "n[i]", "k[i]", "q[i]")
    fresh = _predictive(model, "x.x::DOUBLE", "0::DOUBLE", "0::DOUBLE", "0::DOUBLE")
    return f"""WITH RECURSIVE {cte}, x AS (SELECT series_id, t, {value}::DOUBLE AS x FROM s), b AS (
  SELECT series_id, -1::BIGINT AS t, [0::DOUBLE] AS lp, [0::DOUBLE] AS n, [0::DOUBLE] AS k, [0::DOUBLE] AS q FROM (SELECT DISTINCT series_id FROM x)
  UNION ALL
  SELECT series_id, t, list_transform(raw, lambda v: v - z), list_prepend(1, list_transform(n, lambda v: v + 1)), list_prepend(x, list_transform(k, lambda v: v + x)), list_prepend(x * x, list_transform(q, lambda v: v + x * x)) FROM (
    SELECT *, list_max(raw) + ln(list_sum(list_transform(raw, lambda v: exp(v - list_max(raw))))) AS z FROM (
      SELECT b.series_id, x.t, x.x AS x, n, k, q, list_prepend(
        list_max(lp) + ln(list_sum(list_transform(lp, lambda v: exp(v - list_max(lp))))) + ln({rate}) + {fresh},
        list_transform(range(1, len(lp) + 1), lambda i: lp[i] + ln(1 - {rate}) + {after})) AS raw
      FROM b JOIN x ON x.series_id = b.series_id AND x.t = b.t + 1))
) SELECT series_id, t, round(exp(lp[1]), 6) AS p_change, {mode}round(list_sum(list_transform(range(1, len(lp) + 1), lambda i: (i - 1) * exp(lp[i]))), 4) AS run_length_mean FROM b WHERE t >= 0"""


_ARRIVE = f"WITH {USERS}, a AS (SELECT series_id, t, epoch_us(ts) * 1000 AS t_ns, CASE WHEN t % 5 = 1 THEN 10 * t + 25 ELSE 10 * t END AS arrival_seq FROM s)"
_WINDOW_K1 = _scores(USERS, 5) + f", b AS (SELECT series_id, sum(x_fp::DOUBLE * x_fp) AS b, count(*) AS n FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, split) AS k FROM q) SELECT r.series_id, n, round((b.b - u.v::DOUBLE * u.v / split - (z.v - u.v)::DOUBLE * (z.v - u.v) / (n - split)) / 10000, 1) AS objective, CAST(split AS VARCHAR) AS change_points FROM r JOIN b USING (series_id) JOIN p u ON u.series_id = r.series_id AND u.t = split JOIN p z ON z.series_id = r.series_id AND z.t = n WHERE k = 1"
_STATS = f"WITH {USERS}" + _GAIN.format(ts="", m=2) + ", j AS (SELECT s.series_id, CASE WHEN s.t < r.t THEN 0 ELSE 1 END AS seg_idx, s.t, s.x FROM s JOIN r ON r.series_id = s.series_id AND r.k = 1) SELECT series_id, seg_idx, min(t) AS start, max(t) + 1 AS \"end\", round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, count(*) AS count, 0 AS missing_count FROM j GROUP BY 1, 2"

QUERIES = {
    "best_split_l2": (best_split_l2, _BEST),
    "best_split_l2_users": (best_split_l2_users, f"WITH {USERS}" + _GAIN.format(ts="ts,", m=5) + "SELECT series_id, n, t AS split, gain, ts AS ts_at_split FROM r WHERE k = 1"),
    "best_split_l2_long": (best_split_l2_long, _BEST),
    "best_split_lineitem": (best_split_lineitem, f"WITH {LINEITEM}" + _GAIN.format(ts="ts,", m=2).replace("/ 10000, 6)", "/ 10000, 2)") + "SELECT series_id, n, t AS split, gain, ts AS ts_at_split FROM r WHERE k = 1"),
    "binseg_levels": (binseg_levels, _BINSEG),
    "window_scores": (window_scores, _scores(EVENTS, 10) + " SELECT * FROM q"),
    "window_peaks": (window_peaks, _scores(EVENTS, 10) + ", k AS (SELECT *, coalesce(score > lag(score) OVER w, true) AND coalesce(score >= lead(score) OVER w, true) AS peak FROM q WINDOW w AS (PARTITION BY series_id ORDER BY split)) SELECT series_id, split, score FROM k QUALIFY peak OR NOT bool_or(peak) OVER (PARTITION BY series_id)"),
    "window_top_k": (window_top_k, _scores(USERS, 5) + " SELECT series_id, split, score, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, split) AS place FROM q QUALIFY place <= 3"),
    "wbs_grid": (wbs_grid, f"{_GRID} SELECT series_id, s, s + size AS e FROM i"),
    "wbs_grid_best": (wbs_grid_best, f"{_GRID}, {_PREFIX} {_IN.format(i='i')} QUALIFY row_number() OVER (PARTITION BY i.series_id ORDER BY gain DESC, split, i.s, e) = 1"),
    "wbs_plan": (wbs_plan, _WBS),
    "pelt_l2": (pelt_l2, _optimal(USERS, _L2, 2, "2 * ln(n)")),
    "pelt_normal": (pelt_normal, _optimal(USERS, _NORMAL, 2, "3 * ln(n)")),
    "fpop_l2": (fpop_l2, _optimal(USERS, _L2, 2, "2 * ln(n)")),
    "pelt_manual_jump": (pelt_manual_jump, _optimal(USERS, _L2, 4, "9000::DOUBLE")),
    "pelt_bernoulli": (pelt_bernoulli, _optimal(ERRORS, _BERN, 2, "1 * ln(n)")),
    "dynp_k1": (dynp_k1, _K1),
    "dynp_k2": (dynp_k2, _K2),
    "kernel_linear_k1": (kernel_linear_k1, _K1),
    "binseg_l2_k1": (binseg_l2_k1, _K1),
    "window_l2_k1": (window_l2_k1, _WINDOW_K1),
    "segment_stats": (segment_stats, _STATS),
    "cusum": (cusum, f"WITH {EVENTS}{_CUSUM.format(k=5500)} SELECT series_id, t, round(score, 6) AS score, round(least(score / 400, 1), 6) AS p_change FROM z"),
    "cusum_lineitem": (cusum_lineitem, f"WITH {LINEITEM}{_CUSUM.format(k=2600)} SELECT series_id, t, round(score, 6) AS score, round(least(score / 400, 1), 6) AS p_change FROM z"),
    "page_hinkley": (page_hinkley, f"WITH {EVENTS}, m AS (SELECT series_id, t, x, (sum(x_fp) OVER (PARTITION BY series_id ORDER BY t))::DOUBLE / (t + 1) / 100 AS mu FROM s), c AS (SELECT series_id, t, sum(x - mu - 0.5) OVER (PARTITION BY series_id ORDER BY t) AS c FROM m), z AS (SELECT series_id, t, c - least(0, min(c) OVER (PARTITION BY series_id ORDER BY t)) AS score FROM c) SELECT series_id, t, round(score, 5) AS score, round(least(score / 400, 1), 6) AS p_change FROM z"),
    "alert_gate": (alert_gate, _GATE),
    "cusum_steps": (cusum_steps, f"WITH {USERS}{_CUSUM.format(k=5500)} SELECT series_id, t, round(least(score / 200, 1), 6) AS p_change FROM z"),
    "bocpd_bernoulli": (bocpd_bernoulli, _bocpd(ERRORS, "(1 / 200::DOUBLE)", "bernoulli")),
    "bocpd_gaussian": (bocpd_gaussian, _bocpd(USERS, "(1 / 200::DOUBLE)", "gaussian", "x", "list_position(lp, list_max(lp)) - 1 AS run_length_mode, ")),
    "bocpd_poisson": (bocpd_poisson, None),  # a recursion over thousands of rows in one series takes minutes; tests write it out
    "late_rows": (late_rows, f"{_ARRIVE}, w AS (SELECT series_id, t_ns, max(t_ns) OVER (PARTITION BY series_id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a) SELECT series_id, count(*) AS rows, count(*) FILTER (WHERE t_ns < m) AS late FROM w GROUP BY 1"),
    "watermarks": (watermarks, f"{_ARRIVE} SELECT series_id, t, max(t_ns) OVER (PARTITION BY series_id ORDER BY arrival_seq) AS watermark FROM a"),
    "late_reorder": (late_reorder, None),
    "pelt_nig": (_plain("pelt", "nig"), None),
    "pelt_l1": (_plain("pelt", "l1"), None),
    "pelt_rank": (_plain("pelt", "rank"), None),
    "pelt_poisson": (_plain("pelt", "poisson", rows="orders", constraints={"min_segment_len": 20, "jump": 5}), None),
    "pelt_linear": (_plain("pelt", "linear"), None),
    "pelt_ar": (_plain("pelt", "ar"), None),
    "pelt_ar2": (_plain("pelt", "ar", cost_options={"p": 2}, constraints={"min_segment_len": 6}), None),
    "pelt_full_cov": (_plain("pelt", "normal_full_cov", rows="lineitem", constraints={"min_segment_len": 30, "jump": 30}), None),
    "pelt_cosine": (_plain("pelt", "cosine", rows="lineitem", constraints={"min_segment_len": 30, "jump": 10}), None),
    "pelt_path": (_plain("pelt", "l2", {"path": ["bic", "aic", 5000.0]}), None),
    "pelt_known_k": (_plain("pelt", "l2", {"k": 1}, errors="row"), None),
    "binseg_normal": (_plain("binseg", "normal", rows="event_type"), None),
    "wbs_random": (_plain("wbs", "l2", {"pen": 9000.0}), None),
    "wbs_stratified": (_plain("wbs", "normal", options={"strategy": "stratified", "seed": 7}), None),
    "bottom_up": (_plain("bottom_up", "l2", {"pen": 9000.0}), None),
    "sliding_window": (_plain("window", "normal", rows="event_type"), None),
    "kernel_rbf": (_plain("kernel", "l2", {"k": 2}), None),
    "gp": (_plain("gp", "l2", {"k": 1}), None),
    "argp": (_plain("argp", "l2", {"k": 1}), None),
}
