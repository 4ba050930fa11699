"""Sources, filters, reducers, windows, segment costs and preprocessing."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import native as N
from ..functions.cost_kernels import VAR_FLOOR
from ..functions.scan import CHUNK
from ..operators import diagnostics as D
from ..operators import preprocess as P
from ..operators import splits as S
from ..sources import tables as T
from .base import BLOCKS, ERRORS, EVENTS, GAPS, LINEITEM, ORDERS, SEGS, USERS

#: A period longer than half of a user's series.
PERIOD = 36
R6 = lambda c: F.round(c, 6)


def _fifty(s):
    """Segments of 50 rows."""
    return s.groupBy("series_id", F.floor(F.col("t") / 50).alias("k")).agg(F.min("t").alias("s"), (F.max("t") + 1).alias("e")).drop("k")


def _sums(s, cols):
    return N.segment_sums(_fifty(s), N.prefixes(s, cols), list(cols))


def _ab():
    return {"a": F.col("x_fp"), "b": F.col("x_fp") * F.col("x_fp")}



def cost_l2(spark, d):
    q = _sums(T.events(spark, d), _ab())
    a = F.col("a").cast("double")
    return q.select("series_id", "s", "e", R6(N.l2(F.col("m"), a, F.col("b").cast("double")) / 10000).alias("cost"))


def cost_normal(spark, d):
    q = _sums(T.events(spark, d), _ab())
    return q.select("series_id", "s", "e", R6(N.normal(F.col("m"), F.col("a") / 100.0, F.col("b") / 10000.0)).alias("cost"))


def cost_l1(spark, d):
    s = T.events(spark, d).withColumn("k", F.floor(F.col("t") / 50))
    med = s.groupBy("series_id", "k").agg(F.median("x_fp").alias("med"))
    out = s.join(med, ["series_id", "k"]).groupBy("series_id", "k").agg(F.min("t").alias("s"), (F.max("t") + 1).alias("e"), F.sum(F.abs(F.col("x_fp") - F.col("med"))).alias("c"))
    return out.select("series_id", "s", "e", R6(F.col("c") / 100).alias("cost"))


def cost_poisson(spark, d):
    q = _sums(T.orders_daily(spark, d), {"a": F.col("x_fp")})
    return q.select("series_id", "s", "e", R6(N.poisson(F.col("m"), F.col("a"))).alias("cost"))


def cost_bernoulli(spark, d):
    q = _sums(T.error_flags(spark, d), {"a": F.col("x_fp")})
    return q.select("series_id", "s", "e", R6(N.bernoulli(F.col("m"), F.col("a"))).alias("cost"))


def cost_linear(spark, d):
    q = _sums(T.events(spark, d), _ab() | {"ta": F.col("t") * F.col("x_fp")})
    c = [F.col(k).cast("double") for k in ("m", "a", "b", "ta", "s")]
    return q.select("series_id", "s", "e", F.round(N.linear(*c) / 10000, 4).alias("cost"))


def cost_ar1(spark, d):
    s = T.events(spark, d)
    lag = F.lag("x_fp").over(N.ORDERED())
    s = s.withColumn("y", F.coalesce(lag, F.lit(0)))
    own = s.where(F.col("t") % 50 != 0).groupBy("series_id", F.floor(F.col("t") / 50).alias("k"))
    q = own.agg(F.count(F.lit(1)).alias("r"), F.sum("x_fp").alias("a"), F.sum(F.col("x_fp") * F.col("x_fp")).alias("b"), F.sum("y").alias("u"), F.sum(F.col("y") * F.col("y")).alias("v"), F.sum(F.col("x_fp") * F.col("y")).alias("w"))
    c = [F.col("r").cast("double"), F.col("a") / 100.0, F.col("b") / 10000.0, F.col("u") / 100.0, F.col("v") / 10000.0, F.col("w") / 10000.0]
    return q.where("r > 1").select("series_id", (F.col("k") * 50).alias("s"), F.round(N.ar1(*c), 4).alias("cost"))


def cost_rank(spark, d):
    s = N.mid_rank(T.events(spark, d)).withColumn("x_fp", F.col("r2"))
    q = _sums(s, _ab())
    return q.select("series_id", "s", "e", R6(N.l2(F.col("m"), F.col("a").cast("double"), F.col("b").cast("double")) / 4).alias("cost"))


def cost_cosine(spark, d):
    """Two columns per row (value and the lagged value), as unit vectors."""
    s = T.events(spark, d).withColumn("y", F.coalesce(F.lag("x_fp").over(N.ORDERED()), F.lit(0)))
    p, q = N.unit([F.col("x_fp"), F.col("y")])
    s = s.withColumn("p", p).withColumn("q", q)
    g = s.groupBy("series_id", F.floor(F.col("t") / 50).alias("k")).agg(F.min("t").alias("s"), F.count(F.lit(1)).alias("m"), F.sum(F.round(F.col("p") * 1e9).cast("long")).alias("p"), F.sum(F.round(F.col("q") * 1e9).cast("long")).alias("q"))
    c = N.cosine(F.col("m"), [F.col("p") / 1e9, F.col("q") / 1e9])
    return g.select("series_id", "s", F.round(c, 5).alias("cost"))


def cost_nig(spark, d):
    """Segments of 50 rows, so that the table of log gammas has 50 rows."""
    q = _sums(T.events(spark, d), _ab()).join(F.broadcast(N.lgamma_table(spark, 50)), "m")
    c = N.nig(F.col("m").cast("double"), F.col("a") / 100.0, F.col("b") / 10000.0, F.col("lgamma"))
    return q.select("series_id", "s", "e", R6(c).alias("cost"))


def cost_full_cov_2d(spark, d):
    """Value and lagged value: m times the log determinant of the ridged 2 x 2 covariance, in closed form."""
    s = T.events(spark, d).withColumn("y", F.coalesce(F.lag("x_fp").over(N.ORDERED()), F.lit(0)))
    g = s.groupBy("series_id", F.floor(F.col("t") / 50).alias("k"))
    q = g.agg(F.min("t").alias("s"), F.count(F.lit(1)).alias("m"), *[F.sum(c).alias(k) for k, c in {"a": F.col("x_fp"), "u": F.col("y"), "b": F.col("x_fp") * F.col("x_fp"), "v": F.col("y") * F.col("y"), "w": F.col("x_fp") * F.col("y")}.items()])
    c = N.full_cov_2d(F.col("m").cast("double"), *[F.col(k) / scale for k, scale in (("a", 100.0), ("u", 100.0), ("b", 10000.0), ("v", 10000.0), ("w", 10000.0))])
    return q.where("m > 2").select("series_id", "s", F.round(c, 4).alias("cost"))


def segment_queries(spark, d):
    """Overlapping segment queries by prefix lookup."""
    s = T.events(spark, d)
    n = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    q = n.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 120, F.lit(60).cast("long"))).alias("s")).select("series_id", "s", (F.col("s") + 120).alias("e"))
    q = N.segment_sums(q, N.prefixes(s, {"a": F.col("x_fp")}), ["a"])
    return q.select("series_id", "s", "e", (F.col("a") / 100).alias("total"))


def prefix_sums(spark, d):
    return N.prefixes(T.events(spark, d), _ab()).select("series_id", "t", F.col("a").alias("sum_fp"), F.col("b").alias("sum_sq_fp"))


def prefix_sums_long(spark, d):
    """The same for series that do not fit one task: numbered by ranges, summed by chunks."""
    s = T.events(spark, d, long=True)
    return N.running(s.select("series_id", "t", "x_fp"), {"sum_fp": F.col("x_fp")}, chunk=256).select("series_id", "t", "sum_fp")


def prefix_sums_lineitem(spark, d):
    """All line items as one series."""
    return N.running(T.lineitem_rows(spark, d).select("series_id", "t", "x_fp"), {"sum_fp": F.col("x_fp")}, chunk=CHUNK)


def moments(spark, d):
    s = T.events(spark, d)
    return s.groupBy("series_id").agg(R6(F.avg("x")).alias("mean"), R6(F.var_pop("x")).alias("variance"), F.round(F.kurtosis("x") + 3, 4).alias("kurtosis"), F.count("x").alias("n"), (F.sum("x_fp") / 100).alias("exact_sum"))


def quantiles(spark, d):
    s = T.events(spark, d)
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x)")
    return s.groupBy("series_id").agg(R6(F.median("x")).alias("median"), R6(F.percentile("x", 0.25)).alias("q25"), R6(F.percentile("x", 0.75)).alias("q75"), disc(0.01).alias("d01"), disc(0.99).alias("d99"))


def mad(spark, d):
    return N.mad(T.events(spark, d), ["series_id"]).select("series_id", R6("med").alias("med"), R6(F.col("mad") * 1.4826).alias("mad"))


def outlier_rate(spark, d):
    return D.outlier_rate(T.events(spark, d)).withColumnRenamed("outlier_rate_iqr", "outlier_rate")


def log_sum_exp(spark, d):
    s = T.events(spark, d).withColumn("l", F.col("x") / 100)
    return N.log_sum_exp(s, ["series_id"], "l", "lse").select("series_id", R6("lse").alias("lse"))


def candidate_splits(spark, d):
    return S.candidate_splits(T.events(spark, d, "user_id"), 5, 3).select("series_id", F.col("t").alias("split"), "n")


def valid_rows(spark, d):
    return N.valid_rows(T.with_gaps(T.events(spark, d))).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("x_fp") / 100).alias("total"))


def stride_sample(spark, d):
    return N.stride_sample(T.events(spark, d), 40).select("series_id", "t", "x")


def flatten_missing(spark, d):
    s = T.events(spark, d).withColumn("mask", (F.col("t") % 9 == 4).cast("int"))
    return N.flatten_missing(s, "mask").select("series_id", "t", "x")


def differencing(spark, d):
    return P.difference(T.with_gaps(T.events(spark, d)), 7).select("series_id", "t", R6("x").alias("x"))


def moving_average(spark, d):
    return T.with_gaps(T.events(spark, d)).select("series_id", "t", R6(P.moving_average(5)).alias("ma"))


def rolling_moments(spark, d):
    return D.rolling(T.events(spark, d), 24).select("series_id", "t", R6("m").alias("mean"), F.round("v", 4).alias("var"))


def window_divergence(spark, d):
    return D.divergence(T.events(spark, d), 24).where("d is not null").select("series_id", "t", F.round("d", 5).alias("divergence"))


def autocorrelation(spark, d):
    s = T.events(spark, d)
    cols = [F.lag("x", k).over(N.ORDERED()).alias(f"l{k}") for k in (1, 2, 7)]
    return s.select("series_id", "x", *cols).groupBy("series_id").agg(*[R6(F.corr("x", f"l{k}")).alias(f"acf{k}") for k in (1, 2, 7)])


def mid_ranks(spark, d):
    return N.mid_rank(T.events(spark, d, "user_id")).select("series_id", "t", (F.col("r2") / 2).alias("mid_rank"))


def longest_missing_run(spark, d):
    s = T.with_gaps(T.events(spark, d), "block").where(N.missing())
    return D.longest_runs(s, 16).join(s.groupBy("series_id").agg(F.count(F.lit(1)).alias("missing")), "series_id")


def detrend_linear(spark, d):
    return P.detrend_linear(T.events(spark, d)).select("series_id", "t", F.round("x", 5).alias("x"))


def detrend_quadratic(spark, d):
    return P.detrend_polynomial(T.events(spark, d), 2).select("series_id", "t", F.round("x", 4).alias("x"))


def deseasonalize(spark, d):
    return P.stl_like(T.events(spark, d), 7).select("series_id", "t", F.round("x", 5).alias("x"))


def winsorize(spark, d):
    return P.winsorize(T.events(spark, d)).select("series_id", "t", "x")


def robust_scale(spark, d):
    return P.robust_scale(T.events(spark, d)).select("series_id", "t", R6("x").alias("x"))


def forward_fill(spark, d):
    return P.forward_fill(T.with_gaps(T.events(spark, d))).select("series_id", "t", "x")


def sampling_interval(spark, d):
    return N.sampling_rate(T.events(spark, d)).select("series_id", "interval_us", F.round("rate_hz", 9).alias("rate_hz"))


def deseasonalize_short(spark, d):
    """Users' series with a period so long that they are shorter than the window of the trend; some are shorter than the period."""
    return P.stl_like(T.with_gaps(T.events(spark, d, "user_id")), PERIOD, short="keep").select("series_id", "t", F.round("x", 5).alias("x"))


def gram_linear(spark, d):
    """All pairs of rows of each user's series, with value and place as their two columns, as dot products."""
    s = T.events(spark, d, "user_id").select("series_id", "t", F.array("x", F.col("t").cast("double")).alias("x"))
    return N.gram(s).select("series_id", "i", "j", (F.round("g", 4) + 0.0).alias("g"))


def _kernel_costs(gamma):
    def run(spark, d):
        s = T.events(spark, d, "user_id").select("series_id", "t", F.array("x").alias("x"), F.expr("t div 50").alias("k"))
        return N.kernel_costs(s, gamma).select("series_id", "k", "m", F.round("cost", 5).alias("cost"))

    return run


def log_add_exp(spark, d):
    s = T.events(spark, d, "user_id")
    return s.select("series_id", "t", R6(N.log_add_exp(F.col("x") / 10, F.col("t") / 10)).alias("both"))


def lineitem_profile(spark, d):
    s = T.lineitem_daily(spark, d)
    return s.select(F.posexplode("x").alias("dim", "v"), "t").groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"), F.max("t").alias("last"))


_seg_ab = f"WITH {EVENTS}{SEGS}, q AS (SELECT seg.series_id, seg.s, seg.e, seg.m, sum(x_fp)::DOUBLE AS a, sum(x_fp * x_fp)::DOUBLE AS b, sum(t * x_fp)::DOUBLE AS ta FROM seg JOIN s ON s.series_id = seg.series_id AND s.t >= seg.s AND s.t < seg.e GROUP BY 1, 2, 3, 4)"

def _short_season(period: int = PERIOD) -> str:
    """Two rounds of trend and season, with windows that shrink with the series, by plain joins."""
    trend = "SELECT a.series_id, a.t, avg(b.c) AS tr FROM {c} a JOIN h USING (series_id) JOIN {c} b ON b.series_id = a.series_id AND abs(b.t - a.t) <= half GROUP BY 1, 2"
    season = f"SELECT series_id, t % {period} AS ph, coalesce(avg(x - tr), 0) AS m FROM u JOIN {{t}} USING (series_id, t) GROUP BY 1, 2"
    less = f"SELECT u.series_id, u.t, u.x - (m - (SELECT sum(m) / {period} FROM {{p}} q WHERE q.series_id = u.series_id)) AS c FROM u JOIN {{p}} p ON p.series_id = u.series_id AND p.ph = u.t % {period}"
    return f"""WITH {USERS}, u AS (SELECT series_id, t, CASE WHEN t % 17 = 3 THEN NULL ELSE x END AS x FROM s),
h AS (SELECT series_id, greatest(3, least({2 * period + 1}, count(*) - CASE WHEN count(*) % 2 = 0 THEN 1 ELSE 0 END)) // 2 AS half FROM u GROUP BY 1),
c0 AS (SELECT series_id, t, x AS c FROM u), t1 AS MATERIALIZED ({trend.format(c="c0")}), p1 AS MATERIALIZED ({season.format(t="t1")}), c1 AS MATERIALIZED ({less.format(p="p1")}),
t2 AS MATERIALIZED ({trend.format(c="c1")}), p2 AS MATERIALIZED ({season.format(t="t2")}), c2 AS ({less.format(p="p2")}) SELECT series_id, t, round(c, 5) AS x FROM c2"""


QUERIES = {
    "cost_l2": (cost_l2, f"{_seg_ab} SELECT series_id, s, e, round(greatest(b - a * a / m, 0) / 10000, 6) AS cost FROM q"),
    "cost_normal": (cost_normal, f"{_seg_ab} SELECT series_id, s, e, round(m * ln(greatest(b / 10000 / m - (a / 100 / m) * (a / 100 / m), {VAR_FLOOR!r})), 6) AS cost FROM q"),
    "cost_l1": (cost_l1, f"WITH {EVENTS}, m AS (SELECT series_id, t // 50 AS k, median(x_fp) AS med FROM s GROUP BY 1, 2) SELECT s.series_id, min(t) AS s, max(t) + 1 AS e, round(sum(abs(x_fp - med)) / 100, 6) AS cost FROM s JOIN m ON m.series_id = s.series_id AND m.k = s.t // 50 GROUP BY s.series_id, m.k"),
    "cost_poisson": (cost_poisson, f"WITH {ORDERS}{SEGS} SELECT seg.series_id, s, e, round(CASE WHEN sum(x_fp) > 0 THEN sum(x_fp) - sum(x_fp) * ln(sum(x_fp) / m) ELSE 0 END, 6) AS cost FROM seg JOIN s ON s.t >= s AND s.t < e GROUP BY 1, 2, 3, m"),
    "cost_bernoulli": (cost_bernoulli, f"WITH {ERRORS}{SEGS}, q AS (SELECT seg.series_id, seg.s, seg.e, m, sum(x_fp)::DOUBLE AS k FROM seg JOIN s ON s.series_id = seg.series_id AND s.t >= seg.s AND s.t < seg.e GROUP BY 1, 2, 3, 4) SELECT series_id, s, e, round(CASE WHEN k > 0 AND k < m THEN -(k * ln(k / m) + (m - k) * ln(1 - k / m)) ELSE 0 END, 6) AS cost FROM q"),
    "cost_linear": (cost_linear, f"WITH {EVENTS}{SEGS} SELECT seg.series_id, s, e, round(CASE WHEN any_value(m) <= 1 THEN 0 ELSE greatest(regr_syy(x, t - s) - coalesce(regr_sxy(x, t - s) ^ 2 / nullif(regr_sxx(x, t - s), 0), 0), 0) END, 4) AS cost FROM seg JOIN s ON s.series_id = seg.series_id AND s.t >= s AND s.t < e GROUP BY 1, 2, 3"),
    "cost_ar1": (cost_ar1, f"WITH {EVENTS}, l AS (SELECT series_id, t, x, lag(x) OVER (PARTITION BY series_id ORDER BY t) AS y FROM s) SELECT series_id, t // 50 * 50 AS s, round(count(*) * ln(greatest((regr_syy(x, y) - coalesce(regr_sxy(x, y) ^ 2 / nullif(regr_sxx(x, y), 0), 0)) / count(*), {VAR_FLOOR!r})), 4) AS cost FROM l WHERE t % 50 <> 0 GROUP BY series_id, t // 50 HAVING count(*) > 1"),
    "cost_rank": (cost_rank, f"WITH {EVENTS}, r AS (SELECT series_id, t, rank() OVER (PARTITION BY series_id ORDER BY x) + (count(*) OVER (PARTITION BY series_id, x) - 1) / 2 AS v FROM s) SELECT series_id, min(t) AS s, max(t) + 1 AS e, round(greatest(sum(v * v) - sum(v) * sum(v) / count(*), 0), 6) AS cost FROM r GROUP BY series_id, t // 50"),
    "cost_cosine": (cost_cosine, f"WITH {EVENTS}, l AS (SELECT series_id, t, x_fp::DOUBLE AS x, coalesce(lag(x_fp) OVER (PARTITION BY series_id ORDER BY t), 0)::DOUBLE AS y FROM s) SELECT series_id, min(t) AS s, round(greatest(count(*) - sqrt(sum(CASE WHEN x * x + y * y > 0 THEN x / sqrt(x * x + y * y) ELSE 0 END) ^ 2 + sum(CASE WHEN x * x + y * y > 0 THEN y / sqrt(x * x + y * y) ELSE 0 END) ^ 2), 0), 5) AS cost FROM l GROUP BY series_id, t // 50"),
    "cost_nig": (cost_nig, f"{_seg_ab}, z AS (SELECT *, 1 + 0.5 * greatest(b / 1e4 - (a / 100) * (a / 100) / m, 0) + 0.01 * m * (a / 100 / m) * (a / 100 / m) / (2 * (m + 0.01)) AS bn FROM q) SELECT series_id, s, e, round(-(lgamma(1 + m / 2) - (1 + m / 2) * ln(bn) + 0.5 * (ln(0.01::DOUBLE) - ln(m + 0.01)) - 0.5 * m * ln(2 * pi())), 6) AS cost FROM z"),
    "cost_full_cov_2d": (cost_full_cov_2d, f"WITH {EVENTS}, l AS (SELECT series_id, t, x, coalesce(lag(x) OVER (PARTITION BY series_id ORDER BY t), 0) AS y FROM s), c AS (SELECT series_id, min(t) AS s, count(*) AS m, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM l GROUP BY series_id, t // 50), r AS (SELECT *, greatest(1e-6 * (xx + yy) / 2, {VAR_FLOOR!r}) AS g FROM c) SELECT series_id, s, round(m * ln((xx + g) * (yy + g) - xy * xy), 4) AS cost FROM r WHERE m > 2"),
    "segment_queries": (segment_queries, f"WITH {EVENTS}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), q AS (SELECT series_id, unnest(range(0, n - 119, 60)) AS s FROM n) SELECT q.series_id, q.s, q.s + 120 AS e, sum(x_fp) / 100 AS total FROM q JOIN s ON s.series_id = q.series_id AND s.t >= q.s AND s.t < q.s + 120 GROUP BY 1, 2"),
    "prefix_sums": (prefix_sums, f"WITH {EVENTS} SELECT series_id, t + 1 AS t, (sum(x_fp) OVER w)::BIGINT AS sum_fp, (sum(x_fp * x_fp) OVER w)::BIGINT AS sum_sq_fp FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t) UNION ALL SELECT DISTINCT series_id, 0, 0, 0 FROM s"),
    "prefix_sums_lineitem": (prefix_sums_lineitem, f"WITH {LINEITEM} SELECT series_id, t, x_fp, (sum(x_fp) OVER (ORDER BY t))::BIGINT AS sum_fp FROM s"),
    "prefix_sums_long": (prefix_sums_long, f"WITH {EVENTS} SELECT series_id, t, (sum(x_fp) OVER (PARTITION BY series_id ORDER BY t))::BIGINT AS sum_fp FROM s"),
    "moments": (moments, f"WITH {EVENTS}, m AS (SELECT series_id, avg(x) AS mu FROM s GROUP BY 1) SELECT s.series_id, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(avg((x - mu) ^ 4) / (avg((x - mu) ^ 2) ^ 2), 4) AS kurtosis, count(*) AS n, sum(x_fp) / 100 AS exact_sum FROM s JOIN m USING (series_id) GROUP BY 1"),
    "quantiles": (quantiles, f"WITH {EVENTS} SELECT series_id, round(median(x), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75, quantile_disc(x, 0.01) AS d01, quantile_disc(x, 0.99) AS d99 FROM s GROUP BY 1"),
    "mad": (mad, f"WITH {EVENTS}, m AS (SELECT series_id, median(x) AS med FROM s GROUP BY 1) SELECT s.series_id, round(any_value(med), 6) AS med, round(median(abs(x - med)) * 1.4826, 6) AS mad FROM s JOIN m USING (series_id) GROUP BY 1"),
    "outlier_rate": (outlier_rate, f"WITH {EVENTS}, q AS (SELECT series_id, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM s GROUP BY 1) SELECT s.series_id, count(*) FILTER (WHERE x < lo - 1.5 * (hi - lo) OR x > hi + 1.5 * (hi - lo)) / count(*) AS outlier_rate FROM s JOIN q USING (series_id) GROUP BY 1"),
    "log_sum_exp": (log_sum_exp, f"WITH {EVENTS} SELECT series_id, round(ln(sum(exp(x / 100))), 6) AS lse FROM s GROUP BY 1"),
    "candidate_splits": (candidate_splits, "WITH " + EVENTS.replace("event_type", "user_id") + ", c AS (SELECT series_id, t, count(*) OVER (PARTITION BY series_id) AS n FROM s) SELECT series_id, t AS split, n FROM c WHERE t % 3 = 0 AND t >= 5 AND n - t >= 5"),
    "valid_rows": (valid_rows, f"WITH {GAPS} SELECT series_id, count(*) AS n, sum(x_fp) / 100 AS total FROM g WHERE x IS NOT NULL GROUP BY 1"),
    "stride_sample": (stride_sample, f"WITH {EVENTS} SELECT series_id, t, x FROM s QUALIFY t % 40 = 0 OR t = max(t) OVER (PARTITION BY series_id)"),
    "flatten_missing": (flatten_missing, f"WITH {EVENTS} SELECT series_id, t, CASE WHEN t % 9 = 4 THEN NULL ELSE x END AS x FROM s"),
    "differencing": (differencing, f"WITH {GAPS} SELECT series_id, t, round(CASE WHEN t < 7 THEN x ELSE x - lag(x, 7) OVER (PARTITION BY series_id ORDER BY t) END, 6) AS x FROM g"),
    "moving_average": (moving_average, f"WITH {GAPS} SELECT series_id, t, round(sum(x_fp) OVER w / count(x_fp) OVER w / 100, 6) AS ma FROM g WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"),
    "rolling_moments": (rolling_moments, f"WITH {EVENTS}, r AS (SELECT series_id, t, (sum(x_fp) OVER w)::DOUBLE AS a, (sum(x_fp * x_fp) OVER w)::DOUBLE AS b FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) SELECT series_id, t, round(a / 24 / 100, 6) AS mean, round((b - a * a / 24) / 24 / 10000, 4) AS var FROM r WHERE t >= 23"),
    "window_divergence": (window_divergence, f"WITH {EVENTS}, r AS (SELECT series_id, t, avg(x) OVER w AS m, var_pop(x) OVER w AS v FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)), l AS (SELECT *, lag(m, 24) OVER p AS pm, lag(v, 24) OVER p AS pv FROM r WHERE t >= 23 WINDOW p AS (PARTITION BY series_id ORDER BY t)), sd AS (SELECT series_id, stddev_pop(x) AS sd FROM s GROUP BY 1) SELECT l.series_id, t, round(abs(m - pm) / sd + abs(v - pv) / (sd * sd), 5) AS divergence FROM l JOIN sd USING (series_id) WHERE pm IS NOT NULL"),
    "autocorrelation": (autocorrelation, f"WITH {EVENTS}, l AS (SELECT series_id, x, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b, lag(x, 7) OVER w AS c FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, round(corr(x, a), 6) AS acf1, round(corr(x, b), 6) AS acf2, round(corr(x, c), 6) AS acf7 FROM l GROUP BY 1"),
    "mid_ranks": (mid_ranks, "WITH " + EVENTS.replace("event_type", "user_id") + " SELECT series_id, t, rank() OVER (PARTITION BY series_id ORDER BY x) + (count(*) OVER (PARTITION BY series_id, x) - 1) / 2 AS mid_rank FROM s"),
    "longest_missing_run": (longest_missing_run, f"WITH {BLOCKS}, i AS (SELECT series_id, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS k FROM g WHERE x IS NULL), c AS (SELECT series_id, k, count(*) AS n FROM i GROUP BY 1, 2) SELECT series_id, max(n) AS longest, sum(n)::BIGINT AS missing FROM c GROUP BY 1"),
    "detrend_linear": (detrend_linear, f"WITH {EVENTS}, f AS (SELECT series_id, regr_slope(x, t) AS b, regr_intercept(x, t) AS a FROM s GROUP BY 1) SELECT s.series_id, t, round(x - a - b * t, 5) AS x FROM s JOIN f USING (series_id)"),
    # The rows are numbered without gaps, so that the centred number u and its centred square w are orthogonal.
    "detrend_quadratic": (detrend_quadratic, f"WITH {EVENTS}, a AS (SELECT series_id, avg(t) AS mt, avg(x) AS mx FROM s GROUP BY 1), u AS (SELECT series_id, t, x, mx, t - mt AS u FROM s JOIN a USING (series_id)), m AS (SELECT series_id, avg(u * u) AS mu FROM u GROUP BY 1), w AS (SELECT u.*, u * u - mu AS w FROM u JOIN m USING (series_id)), f AS (SELECT series_id, sum(u * x) / sum(u * u) AS b, sum(w * x) / sum(w * w) AS c FROM w GROUP BY 1) SELECT series_id, t, round(x - mx - b * u - c * w, 4) AS x FROM w JOIN f USING (series_id)"),
    "deseasonalize": (deseasonalize, f"""WITH {EVENTS}, t1 AS (
  SELECT *, t % 7 AS ph, avg(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS tr FROM s
), m1 AS (SELECT series_id, ph, avg(x - tr) AS m FROM t1 GROUP BY 1, 2), s1 AS (SELECT series_id, ph, m - avg(m) OVER (PARTITION BY series_id) AS season FROM m1),
t2 AS (SELECT t1.series_id, t1.t, t1.ph, x, avg(x - season) OVER (PARTITION BY t1.series_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS tr FROM t1 JOIN s1 ON s1.series_id = t1.series_id AND s1.ph = t1.ph),
m2 AS (SELECT series_id, ph, avg(x - tr) AS m FROM t2 GROUP BY 1, 2), s2 AS (SELECT series_id, ph, m - avg(m) OVER (PARTITION BY series_id) AS season FROM m2)
SELECT t2.series_id, t, round(x - season, 5) AS x FROM t2 JOIN s2 ON s2.series_id = t2.series_id AND s2.ph = t2.ph"""),
    "winsorize": (winsorize, f"WITH {EVENTS}, q AS (SELECT series_id, quantile_disc(x, 0.01) AS lo, quantile_disc(x, 0.99) AS hi FROM s GROUP BY 1) SELECT s.series_id, t, least(greatest(x, lo), hi) AS x FROM s JOIN q USING (series_id)"),
    "robust_scale": (robust_scale, f"WITH {EVENTS}, m AS (SELECT series_id, median(x) AS med FROM s GROUP BY 1), d AS (SELECT s.series_id, any_value(med) AS med, median(abs(x - med)) AS mad FROM s JOIN m USING (series_id) GROUP BY 1) SELECT s.series_id, t, round((x - med) / greatest(1.4826 * mad, 1e-9), 6) AS x FROM s JOIN d USING (series_id)"),
    "forward_fill": (forward_fill, f"WITH {GAPS} SELECT series_id, t, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t), 0) AS x FROM g"),
    "deseasonalize_short": (deseasonalize_short, _short_season()),
    "sampling_interval": (sampling_interval, f"WITH {EVENTS}, d AS (SELECT series_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY t)) AS g FROM s) SELECT series_id, median(g) AS interval_us, round(1e6 / median(g), 9) AS rate_hz FROM d WHERE g > 0 GROUP BY 1"),
    "kernel_costs_linear": (_kernel_costs(None), f"WITH {USERS} SELECT series_id, t // 50 AS k, count(*) AS m, round(sum(x * x) - sum(x) * sum(x) / count(*), 5) AS cost FROM s GROUP BY 1, 2"),
    "kernel_costs_rbf": (_kernel_costs(1e-4), f"WITH {USERS} SELECT a.series_id, a.t // 50 AS k, count(*) FILTER (WHERE a.t = b.t) AS m, round(greatest(count(*) FILTER (WHERE a.t = b.t) - sum(exp(-1e-4 * (a.x - b.x) ^ 2)) / count(*) FILTER (WHERE a.t = b.t), 0), 5) AS cost FROM s a JOIN s b ON a.series_id = b.series_id AND a.t // 50 = b.t // 50 GROUP BY 1, 2"),
    "log_add_exp": (log_add_exp, f"WITH {USERS} SELECT series_id, t, round(greatest(x, t) / 10 + ln(1 + exp((least(x, t) - greatest(x, t)) / 10)), 6) AS both FROM s"),
    "gram_linear": (gram_linear, f"WITH {USERS} SELECT a.series_id, a.t AS i, b.t AS j, round(a.x * b.x + a.t * b.t, 4) + 0 AS g FROM s a JOIN s b ON a.series_id = b.series_id AND a.t <= b.t"),
    "lineitem_profile": (lineitem_profile, "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*)::DOUBLE AS a, sum(l_quantity) AS b, sum(CAST(trunc(l_extendedprice * 100) AS BIGINT))::DOUBLE AS c FROM lineitem GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS t FROM d) SELECT 0 AS dim, count(*) AS n, round(sum(a), 2) AS total, max(t) AS last FROM n UNION ALL SELECT 1, count(*), round(sum(b), 2), max(t) FROM n UNION ALL SELECT 2, count(*), round(sum(c), 2), max(t) FROM n"),
}

