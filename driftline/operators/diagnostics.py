"""Profiles of series: missing values, moments, dependence, periods and drift, as plans. One row per series; a series with
several columns (x as an array) has the medians of its columns' profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import native as N
from ..functions.scan import CHUNK
from ..functions.storage import written
from .grouped import by_series

#: Rows above which a profile is made from a stride sample: a tenth of them, within these bounds, or some more.
SUBSAMPLE_ABOVE, SUBSAMPLE_FROM, SUBSAMPLE_TO = 100_000, 10_000, 50_000
LEAST_VALID, MAX_LAG, LAG, WINDOW = 32, 128, 8, 128
#: Spreads and strengths up to this count as none; the share of values that makes a series one of flags or counts.
TINY, SHARE = 1e-12, 0.98


def subsampled(s: DataFrame) -> DataFrame:
    """Long series by stride, renumbered, with the last row kept; short ones as they are. At most SUBSAMPLE_ABOVE + 1 rows stay
    of any series. Places follow from t, which counts rows from 0, so that no window over a series is needed."""
    n = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    goal = F.least(F.greatest(F.expr("_n div 10"), F.lit(SUBSAMPLE_FROM)), F.lit(SUBSAMPLE_TO))
    stride = F.when(F.col("_n") > SUBSAMPLE_ABOVE, F.greatest(F.floor(F.col("_n") / goal), F.lit(1))).otherwise(F.lit(1))
    cut = s.join(n, "series_id").withColumn("_s", stride).withColumn("used_subsampling", F.col("_n") > SUBSAMPLE_ABOVE)
    cut = cut.where((F.col("t") % F.col("_s") == 0) | (F.col("t") == F.col("_n") - 1))
    return cut.withColumn("t", F.expr("t div _s") + F.when(F.col("t") % F.col("_s") == 0, 0).otherwise(1)).drop("_n", "_s")


def longest_runs(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """series_id and longest, the most consecutive t among rows (series_id, t).

    Runs are found within chunks; those that touch the border of a chunk, two a chunk at most, are put together by series.
    """
    cut = rows.select("series_id", "t", F.floor(F.col("t") / chunk).alias("_k"))
    inner = W.partitionBy("series_id", "_k").orderBy("t")
    runs = cut.withColumn("_g", F.col("t") - F.row_number().over(inner)).groupBy("series_id", "_k", "_g").agg(F.min("t").alias("_from"), (F.max("t") + 1).alias("_to"))
    edge = (F.col("_from") % chunk == 0) | (F.col("_to") % chunk == 0)
    order = W.partitionBy("series_id").orderBy("_from")
    met = runs.where(edge).withColumn("_new", (F.coalesce(F.lag("_to").over(order), F.lit(-1)) != F.col("_from")).cast("int"))
    whole = met.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("series_id", "_run").agg(F.sum(F.col("_to") - F.col("_from")).alias("k"))
    return runs.where(~edge).select("series_id", (F.col("_to") - F.col("_from")).alias("k")).unionByName(whole.select("series_id", "k")).groupBy("series_id").agg(F.max("k").alias("longest"))


def missing_overview(s: DataFrame) -> DataFrame:
    """series_id, n, missing, rate, longest run and pattern: none, block (one run holds a quarter, 8 at least) or random."""
    miss = N.missing()
    by = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(miss).alias("missing"))
    out = by.join(longest_runs(s.where(miss)), "series_id", "left").withColumn("longest", F.coalesce("longest", F.lit(0).cast("long")))
    block = F.col("longest") >= F.greatest(F.lit(8), F.ceil(F.col("missing") / 4))
    return out.select("series_id", "n", "missing", (F.col("missing") / F.col("n")).alias("nan_rate"), "longest", F.when(F.col("missing") == 0, "none").when(block, "block").otherwise("random").alias("pattern"))


def autocorrelations(s: DataFrame, lags, chunk: int = CHUNK) -> DataFrame:
    """series_id, lag, acf: Pearson correlation of the valid pairs; 0 with fewer than three.

    Chunks of a series, each with the rows before it that its lags reach, give for every lag the number, means and co-moments of their
    pairs; these few rows are combined by series. A series may have any number of chunks.
    """
    lags = sorted(lags)
    reach = lags[-1]
    size = max(chunk, 4 * reach)
    k = F.floor(F.col("t") / size)
    late = F.col("t") % size >= size - reach  # also wanted by the chunk behind
    rows = s.select("series_id", "t", "x", F.explode(F.when(late, F.array(k, k + 1)).otherwise(F.array(k))).alias("_k"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("t")
        at, x, block = group.column("t").to_numpy(), group.column("x").to_numpy().astype(np.float64), group.column("_k")[0].as_py()
        full = np.full(size + reach, np.nan)
        full[at - (block * size - reach)] = x
        out = []
        for lag in lags:
            a, b = full[reach:], full[reach - lag : -lag]
            ok = ~(np.isnan(a) | np.isnan(b))
            if ok.any():
                a, b = a[ok], b[ok]
                u, v = a - a.mean(), b - b.mean()
                out.append((lag, len(a), a.mean(), b.mean(), u @ u, v @ v, u @ v))
        cols = [pa.array([group.column("series_id")[0].as_py()] * len(out), pa.string())]
        cols += [pa.array([r[i] for r in out], pa.int32() if i == 0 else pa.int64() if i == 1 else pa.float64()) for i in range(7)]
        return pa.table(cols, names=["series_id", "lag", "m", "a", "b", "aa", "bb", "ab"])

    parts = rows.groupBy("series_id", "_k").applyInArrow(run, "series_id string, lag int, m bigint, a double, b double, aa double, bb double, ab double")
    mean = lambda c: F.sum(F.col("m") * F.col(c)) / F.sum("m")
    whole = parts.join(parts.groupBy("series_id", "lag").agg(mean("a").alias("_a"), mean("b").alias("_b")), ["series_id", "lag"])
    da, db = F.col("a") - F.col("_a"), F.col("b") - F.col("_b")
    by = whole.groupBy("series_id", "lag").agg(F.sum("m").alias("m"), F.sum(F.col("aa") + F.col("m") * da * da).alias("aa"), F.sum(F.col("bb") + F.col("m") * db * db).alias("bb"), F.sum(F.col("ab") + F.col("m") * da * db).alias("ab"))
    r = F.when((F.col("m") >= 3) & (F.col("aa") > 0) & (F.col("bb") > 0), F.greatest(F.least(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(0.0))
    every = s.select("series_id").distinct().select("series_id", F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    return every.join(by.select("series_id", "lag", r.alias("acf")), ["series_id", "lag"], "left").select("series_id", "lag", F.coalesce("acf", F.lit(0.0)).alias("acf"))


def autocovariances(s: DataFrame, max_lag: int) -> DataFrame:
    """series_id, lag, r for lags 1 to max_lag: the mean product of valid values so far apart, less the series' mean, over the
    variance. Missing rows are left out before lags are taken. 0 for a series without spread or with at most max_lag + 2 values."""
    own = N.valid_rows(s)
    by = own.groupBy("series_id").agg(F.avg("x").alias("_m"), F.var_pop("x").alias("_v"), F.count("x").alias("_n"))
    c = own.join(by, "series_id").select("series_id", "t", "_v", "_n", (F.col("x") - F.col("_m")).alias("_c"))
    ahead = c.select("series_id", "_v", "_n", *[(F.col("_c") * F.lag("_c", k).over(N.ORDERED())).alias(f"_{k}") for k in range(1, max_lag + 1)])
    agg = ahead.groupBy("series_id", "_v", "_n").agg(*[F.avg(f"_{k}").alias(f"_{k}") for k in range(1, max_lag + 1)])
    some = (F.col("_v") > TINY) & (F.col("_n") > max_lag + 2)
    r = lambda k: F.when(some, F.greatest(F.least(F.col(f"_{k}") / F.col("_v"), F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(0.0))
    return agg.select("series_id", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), r(k).alias("r")) for k in range(1, max_lag + 1)])).alias("p")).select("series_id", "p.lag", "p.r")


def partial(r: list[float]) -> list[float]:
    """Partial autocorrelations from the autocorrelations of lags 1, 2, ... by Durbin-Levinson."""
    r = np.concatenate([[1.0], r])
    phi, out, noise = np.zeros(0), [], 1.0
    for k in range(1, len(r)):
        a = 0.0 if noise <= TINY else float(np.clip((r[k] - phi @ r[k - 1 : 0 : -1]) / noise, -1, 1))
        phi = np.append(phi - a * phi[::-1], a)
        noise = max(noise * (1 - a * a), TINY)
        out.append(a)
    return out


def pacf(r: DataFrame, max_lag: int) -> DataFrame:
    """Partial autocorrelations of lags 1 to max_lag over each series' few autocovariances (lag, r)."""

    def run(group: pa.Table) -> pa.Table:
        out = partial(group.sort_by("lag").column("r").to_pylist()[:max_lag])
        return pa.table({"series_id": [group.column("series_id")[0].as_py()] * len(out), "lag": pa.array(range(1, len(out) + 1), pa.int32()), "pacf": out})

    return r.groupBy("series_id").applyInArrow(run, "series_id string, lag int, pacf double")


def supported(acf: DataFrame, s: DataFrame) -> DataFrame:
    """The autocorrelations up to a quarter of the series' valid rows; longer lags have too few pairs to tell a period."""
    valid = N.valid_rows(s).groupBy("series_id").agg(F.count(F.lit(1)).alias("_valid"))
    return acf.join(valid, "series_id").where(F.col("lag") <= F.col("_valid") / 4).drop("_valid")


def dominant_period(acf: DataFrame) -> DataFrame:
    """series_id, period, strength from the autocorrelations of lags 1, 2, ...: the smallest lag within 5 % of the strongest peak.

    A peak is a positive value from lag 2 on that none of its neighbours exceeds; the last lag has one neighbour only. Without
    a peak all positive values from lag 2 on take their place, and without one of those the series has no row.
    """
    order = W.partitionBy("series_id").orderBy("lag")
    size = F.greatest("acf", F.lit(0.0))
    seen = acf.select("series_id", "lag", size.alias("acf")).withColumn("_left", F.lag("acf").over(order)).withColumn("_right", F.coalesce(F.lead("acf").over(order), F.col("acf")))
    own = seen.where((F.col("lag") >= 2) & (F.col("acf") > TINY)).withColumn("_peak", (F.col("acf") >= F.col("_left")) & (F.col("acf") >= F.col("_right")))
    some = F.max("_peak").over(W.partitionBy("series_id"))
    tops = own.withColumn("_some", some).where("_peak or not _some").withColumn("_top", F.max("acf").over(W.partitionBy("series_id")))
    near = tops.where(F.col("acf") >= 0.95 * F.col("_top"))
    return near.groupBy("series_id").agg(F.min(F.struct("lag", "acf")).alias("m")).select("series_id", F.col("m.lag").alias("period"), F.col("m.acf").alias("strength"))


def period_votes(periods: DataFrame, k: int = 3) -> DataFrame:
    """Periods (period, strength) by summed strength; the k best, ties to the shorter."""
    by = periods.groupBy("period").agg(F.sum("strength").alias("strength"))
    return by.withColumn("place", F.row_number().over(W.partitionBy().orderBy(F.desc("strength"), "period"))).where(F.col("place") <= k)


def rolling(s: DataFrame, window: int = WINDOW) -> DataFrame:
    """series_id, t, m and v: mean and variance of the last `window` rows, where there are as many. Values must be valid, t dense."""
    full = N.ORDERED().rowsBetween(1 - window, 0)
    return s.select("series_id", "t", F.avg("x").over(full).alias("m"), F.var_pop("x").over(full).alias("v")).where(F.col("t") >= window - 1)


def divergence(s: DataFrame, window: int = WINDOW) -> DataFrame:
    """rolling(s), and d: how far mean and variance are from those of the window before, in terms of the whole series' spread;
    null where no window is before."""
    whole = s.groupBy("series_id").agg(F.var_pop("x").alias("_var"))
    prior = lambda c: F.lag(c, window).over(N.ORDERED())
    moves = rolling(s, window).withColumn("dm", F.abs(F.col("m") - prior("m"))).withColumn("dv", F.abs(F.col("v") - prior("v"))).join(whole, "series_id")
    return moves.withColumn("d", F.col("dm") / (F.sqrt("_var") + TINY) + F.col("dv") / (F.col("_var") + TINY)).drop("dm", "dv")


def drift(s: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spread of the rolling means and variances in terms of the whole series', the largest divergence of neighbouring windows
    (regime_change_proxy) and the share of divergences above 1 (change_density_score), over valid values. A measure for which
    there are too few values is 0."""
    own = N.valid_rows(s).withColumn("t", F.row_number().over(N.ORDERED()) - 1)
    by = divergence(own, window).groupBy("series_id").agg(
        (F.stddev_pop("m") / (F.sqrt(F.max("_var")) + TINY)).alias("rolling_mean_drift"),
        (F.stddev_pop("v") / (F.avg("v") + TINY)).alias("rolling_variance_drift"),
        F.max("d").alias("regime_change_proxy"),
        F.try_divide(F.count_if(F.col("d") > 1), F.count("d")).alias("change_density_score"),
    )
    measures = ("rolling_mean_drift", "rolling_variance_drift", "regime_change_proxy", "change_density_score")
    return own.select("series_id").distinct().join(by, "series_id", "left").select("series_id", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in measures])


def outlier_rate(s: DataFrame) -> DataFrame:
    """series_id and outlier_rate_iqr, the share of valid values more than 1.5 interquartile ranges outside; 0 below four values."""
    own = N.valid_rows(s)
    q = own.groupBy("series_id").agg(F.percentile("x", 0.25).alias("_lo"), F.percentile("x", 0.75).alias("_hi"))
    far = (F.col("x") < F.col("_lo") - 1.5 * (F.col("_hi") - F.col("_lo"))) | (F.col("x") > F.col("_hi") + 1.5 * (F.col("_hi") - F.col("_lo")))
    n = F.count(F.lit(1))
    return own.join(q, "series_id").groupBy("series_id").agg(F.when(n < 4, F.lit(0.0)).otherwise(F.count_if(far) / n).alias("outlier_rate_iqr"))


def shape(s: DataFrame) -> DataFrame:
    """Moments, robust spread and outlier rate of the valid rows."""
    own = N.valid_rows(s)
    robust = N.mad(own, ["series_id"])
    q = own.groupBy("series_id").agg(F.count("x").alias("valid"), F.var_pop("x").alias("var"), (F.kurtosis("x") + 3).alias("k"))
    out = outlier_rate(s)
    kurt = F.when((F.col("valid") < 4) | (F.col("var") <= 2.3e-16), F.lit(0.0)).otherwise(F.col("k"))
    return q.join(robust, "series_id").join(out, "series_id").select("series_id", "valid", kurt.alias("kurtosis_proxy"), "outlier_rate_iqr", F.when(F.col("var") > 0, F.col("mad") * 1.4826 / F.sqrt("var")).otherwise(F.lit(1.0)).alias("mad_to_std_ratio"), F.sqrt("var").alias("std"), (F.col("mad") * 1.4826).alias("robust_std"))


def residual_lag1(s: DataFrame) -> DataFrame:
    from .preprocess import detrend_linear

    return autocorrelations(detrend_linear(s), [1]).select("series_id", F.col("acf").alias("residual_lag1_autocorr"))


def hints(s: DataFrame, share: float = SHARE, tolerance: float = 1e-9) -> DataFrame:
    """binary_like, count_like: nearly all valid values are 0 or 1, or whole and not negative."""
    whole = F.abs(F.col("x") - F.round("x")) <= tolerance
    binary = whole & F.round("x").isin(0.0, 1.0)
    return N.valid_rows(s).groupBy("series_id").agg((F.avg(binary.cast("double")) >= share).alias("binary_like"), ((F.avg((whole & (F.col("x") >= -tolerance)).cast("double")) >= share) & (F.avg(binary.cast("double")) < share)).alias("count_like"))


def _columns(s: DataFrame) -> DataFrame:
    """Each column of a series with x as an array as a series of its own, named series_id, tab, number."""
    if not isinstance(s.schema["x"].dataType, ArrayType):
        return s.select("series_id", "t", "x", F.col("series_id").alias("_of"))
    each = s.select(F.col("series_id").alias("_of"), "t", F.posexplode("x").alias("_dim", "x"))
    return each.select(F.concat_ws("\t", "_of", "_dim").alias("series_id"), "t", F.col("x").cast("double").alias("x"), "_of")


#: The measures of a profile whose medians over its columns describe a series.
MEASURES = (
    "kurtosis_proxy", "outlier_rate_iqr", "mad_to_std_ratio", "std", "robust_std", "lag1_autocorr", "lagk_autocorr", "pacf_lagk_proxy",
    "residual_lag1_autocorr", "rolling_mean_drift", "rolling_variance_drift", "regime_change_proxy", "change_density_score",
)
_MEASURED = "series_id string, used_subsampling boolean, valid bigint, binary bigint, counts bigint, acf array<double>, " + ", ".join(f"{k} double" for k in MEASURES)


def _pearson(a: np.ndarray, b: np.ndarray) -> float:
    """The correlation of the pairs that are both there; 0 with fewer than three or without spread."""
    ok = ~(np.isnan(a) | np.isnan(b))
    a, b = a[ok], b[ok]
    if len(a) < 3:
        return 0.0
    a, b = a - a.mean(), b - b.mean()
    spread = np.sqrt((a @ a) * (b @ b))
    return float(np.clip(a @ b / spread, -1, 1)) if spread > 0 else 0.0


def measured(x: np.ndarray, lag: int, max_lag: int, window: int) -> dict:
    """The measures of one column in the order of its rows, NaN where missing; the same as the plans of this module give."""
    v = x[~np.isnan(x)]
    n, t = len(v), np.nonzero(~np.isnan(x))[0].astype(np.float64)
    if n < LEAST_VALID:
        return {"valid": n, "acf": []}
    c = v - v.mean()
    var = float(c @ c) / n
    med, lo, hi = np.quantile(v, [0.5, 0.25, 0.75])
    mad, std = float(np.median(np.abs(v - med))), var**0.5
    line = np.polyval(np.polyfit(t - t.mean(), v, 1), t - t.mean()) if n >= 2 else 0.0
    rest = x.copy()
    rest[~np.isnan(x)] = v - line
    whole = np.abs(v - np.round(v)) <= 1e-9
    acf = [_pearson(x[k:], x[:-k]) for k in range(1, max_lag + 1)]
    r = [float(np.clip((c[k:] @ c[:-k]) / (n - k) / var, -1, 1)) if var > TINY and n > lag + 2 else 0.0 for k in range(1, lag + 1)]
    out = {
        "valid": n, "binary": int((whole & np.isin(np.round(v), (0.0, 1.0))).sum()), "counts": int((whole & (v >= -1e-9)).sum()), "acf": acf,
        "kurtosis_proxy": 0.0 if var <= 2.3e-16 else float((c**4).mean() / var**2), "outlier_rate_iqr": float(((v < lo - 1.5 * (hi - lo)) | (v > hi + 1.5 * (hi - lo))).mean()),
        "mad_to_std_ratio": mad * 1.4826 / std if var > 0 else 1.0, "std": std, "robust_std": mad * 1.4826, "lag1_autocorr": acf[0], "lagk_autocorr": _pearson(x[lag:], x[:-lag]),
        "pacf_lagk_proxy": partial(r)[-1], "residual_lag1_autocorr": _pearson(rest[1:], rest[:-1]), **dict.fromkeys(MEASURES[9:], 0.0),
    }
    if n >= window:
        sums, squares = np.cumsum(np.append(0.0, c)), np.cumsum(np.append(0.0, c * c))
        m = (sums[window:] - sums[:-window]) / window
        s2 = np.maximum((squares[window:] - squares[:-window]) / window - m * m, 0.0)
        d = np.abs(m[window:] - m[:-window]) / (std + TINY) + np.abs(s2[window:] - s2[:-window]) / (var + TINY)
        out |= {"rolling_mean_drift": float(m.std() / (std + TINY)), "rolling_variance_drift": float(s2.std() / (s2.mean() + TINY))}
        out |= {"regime_change_proxy": float(d.max(initial=0.0)), "change_density_score": float((d > 1).mean()) if len(d) else 0.0}
    return out


def profiles(s: DataFrame, lag: int = LAG, max_lag: int = MAX_LAG, window: int = WINDOW) -> DataFrame:
    """The measures of each series with one column, and its autocorrelations, in one pass over its sample in the order of its rows.

    A sample has at most SUBSAMPLE_ABOVE + 1 rows, whatever the length of the series, so that one task can hold it.
    """

    def run(rows: pa.Table) -> list[dict]:
        own = measured(rows.column("x").to_numpy().astype(np.float64), lag, max_lag, window)
        return [{"series_id": rows.column("series_id")[0].as_py(), "used_subsampling": rows.column("used_subsampling")[0].as_py(), **own}]

    return by_series(subsampled(s).select("series_id", "t", "x", "used_subsampling"), "t", run, _MEASURED)


def diagnostics(s: DataFrame, lag: int = LAG, max_lag: int = MAX_LAG, window: int = WINDOW) -> DataFrame:
    """One profile per series with at least one column of LEAST_VALID valid rows.

    n counts rows, missing values are counted over all columns (nan_rate is their share of all values, the pattern that of the
    columns with more of them), periods are voted by the columns with their strengths, the values of all columns together tell
    whether they are flags or counts, and the other measures are medians.
    """
    each = _columns(s)
    names = each.select("series_id", "_of").distinct()
    gaps = missing_overview(each.select("series_id", "t", "x")).join(names, "series_id")  # of all rows; the rest is measured on the sample
    weight = lambda pattern: F.sum(F.when(F.col("pattern") == pattern, F.col("missing")).otherwise(F.lit(0)))
    overview = gaps.groupBy("_of").agg(
        F.max("n").alias("n"), F.sum("missing").alias("missing"), (F.sum("missing") / F.sum("n")).alias("nan_rate"), F.max("longest").alias("longest"),
        F.when(F.sum("missing") == 0, "none").when(weight("block") >= weight("random"), "block").otherwise("random").alias("pattern"), F.count(F.lit(1)).alias("dimensions"),
    )
    # A pass over the rows costs more than the profiles are large: they are written and used twice.
    own = written(profiles(each.select("series_id", "t", "x"), lag, max_lag, window).where(F.col("valid") >= LEAST_VALID).join(names, "series_id"), "profiles")
    by = own.groupBy("_of").agg(F.sum("valid").alias("valid"), F.count(F.lit(1)).alias("valid_dimensions"), *[F.median(k).alias(k) for k in MEASURES], F.max("used_subsampling").alias("used_subsampling"), F.sum("binary").alias("_b"), F.sum("counts").alias("_c"))
    binary = F.col("_b") >= SHARE * F.col("valid")
    by = by.withColumn("binary_like", binary).withColumn("count_like", ~binary & (F.col("_c") >= SHARE * F.col("valid"))).drop("_b", "_c")
    acf = own.select("series_id", "valid", F.posexplode("acf").alias("lag", "acf")).select("series_id", (F.col("lag") + 1).alias("lag"), "acf", "valid").where(F.col("lag") <= F.col("valid") / 4).drop("valid")
    votes = dominant_period(acf).join(names, "series_id").groupBy("_of", "period").agg(F.sum("strength").alias("strength"))
    best = votes.groupBy("_of").agg(F.max(F.struct("strength", (-F.col("period")).alias("rank"))).alias("b")).select("_of", (-F.col("b.rank")).alias("period"), F.col("b.strength").alias("strength"))
    got = overview.join(by, "_of").join(best, "_of", "left").fillna(0.0, ["strength"])
    return got.withColumnRenamed("_of", "series_id")


def signal_flags(d: DataFrame) -> DataFrame:
    """Thresholded signals of a profile. The thresholds."""
    c = F.col
    auto = (c("lag1_autocorr") >= 0.55) | (c("lagk_autocorr") >= 0.45) | (c("residual_lag1_autocorr") >= 0.40)
    heavy = (c("kurtosis_proxy") >= 4.0) | (c("outlier_rate_iqr") >= 0.02) | (c("mad_to_std_ratio") <= 0.80)
    dense = (c("change_density_score") >= 0.35) | (c("regime_change_proxy") >= 1.20)
    few = (c("change_density_score") < 0.12) & (c("regime_change_proxy") >= 0.80)
    masking = (c("pattern") == "block") | (c("nan_rate") >= 0.10)
    low = (c("change_density_score") < 0.05) & (c("regime_change_proxy") < 0.25)
    out = d.withColumn("huge_n", c("n") >= 100_000).withColumn("medium_n", c("n").between(1_000, 99_999))
    for name, col in {"autocorrelated": auto, "heavy_tail": heavy, "change_dense": dense, "few_strong_changes": few, "masking_risk": masking, "low_signal": low}.items():
        out = out.withColumn(name, col)
    few_columns = c("valid_dimensions") * 2 < c("dimensions")
    return out.withColumn("conflicting_signals", (c("autocorrelated") & c("heavy_tail") & (c("n") < 1_000)) | (c("low_signal") & (c("autocorrelated") | c("heavy_tail"))) | few_columns)


#: Signals by priority, the first wins a tie of scores.
PRIORITY = ("binary_like", "count_like", "autocorrelated", "heavy_tail", "change_dense", "few_strong_changes", "masking_risk", "low_signal")


def strongest_signal(flags: DataFrame) -> DataFrame:
    """The active signal that exceeds its threshold most; ties by priority."""
    c = F.col
    score = {
        "binary_like": F.lit(2.0),
        "count_like": F.lit(1.8),
        "autocorrelated": F.greatest(c("lag1_autocorr") / 0.55, c("lagk_autocorr") / 0.45, c("residual_lag1_autocorr") / 0.40),
        "heavy_tail": F.greatest(c("kurtosis_proxy") / 4.0, c("outlier_rate_iqr") / 0.02, F.when(c("mad_to_std_ratio") <= 0.80, 0.80 / F.greatest(c("mad_to_std_ratio"), F.lit(1e-12))).otherwise(F.lit(0.0))),
        "change_dense": F.greatest(c("change_density_score") / 0.35, c("regime_change_proxy") / 1.20),
        "few_strong_changes": F.greatest(c("regime_change_proxy") / 0.80, F.lit(1.0)),
        "masking_risk": F.greatest(c("nan_rate") / 0.10, F.lit(1.0)),
        "low_signal": 1.0 + F.greatest(0.05 - c("change_density_score"), F.lit(0.0)) / 0.05 + F.greatest(0.25 - c("regime_change_proxy"), F.lit(0.0)) / 0.25,
    }
    entries = F.array(*[F.when(c(k), F.struct(score[k].cast("double").alias("score"), F.lit(len(PRIORITY) - i).alias("rank"), F.lit(k).alias("name"))) for i, k in enumerate(PRIORITY)])
    return flags.withColumn("strongest", F.array_max(F.filter(entries, lambda e: e.isNotNull()))["name"])


def seasonality(acf: DataFrame) -> DataFrame:
    """series_id, lag and strength, the largest absolute value among autocorrelations (lag, acf, n) of lags from 2 to a quarter
    of n; ties go to the shorter lag, and without a value that is not 0 the lag is 0."""
    own = acf.where((F.col("lag") >= 2) & (F.col("lag") <= F.floor(F.col("n") / 4)) & (F.col("acf") != 0))
    best = own.groupBy("series_id").agg(F.max(F.struct(F.abs("acf").alias("strength"), (-F.col("lag")).alias("o"))).alias("b"))
    return best.select("series_id", (-F.col("b.o")).alias("lag"), F.col("b.strength").alias("strength"))


def preprocessing_advice(s: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """series_id and, where the signals ask for it, detrend, difference_by (a period), winsorize, robust_scale; and the signals.

    Each signal is the mean over the columns with at least three valid rows: the size of the correlation with time, the largest
    size of an autocorrelation of lags 2 to max_lag (at most a quarter of n), the share of rows farther from the median than 3.5
    robust deviations, and the size of the logarithm of the ratio of spreads. The period is that of the column with the strongest
    seasonality. Series without such a column have no row. Fixed values: the thresholds 0.25, 0.35, 0.02 and 0.35.
    """
    each = _columns(s)
    names = each.select("series_id", "_of").distinct()
    each = each.select("series_id", "t", "x")
    own = N.valid_rows(each)
    size = each.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~N.missing()).alias("_valid"))
    trend = own.groupBy("series_id").agg(F.abs(F.coalesce(F.corr("x", F.col("t").cast("double")), F.lit(0.0))).alias("trend"), F.stddev_pop("x").alias("_std"))
    season = seasonality(autocorrelations(each, range(1, max_lag + 1)).join(size, "series_id"))
    med = N.mad(own, ["series_id"]).withColumn("_scale", F.greatest(1.4826 * F.col("mad"), F.lit(1e-9)))
    far = own.join(med, "series_id").groupBy("series_id").agg(F.avg((F.abs(F.col("x") - F.col("med")) / F.col("_scale") > 3.5).cast("double")).alias("outliers"), F.first("_scale").alias("_scale"))
    ratio = F.abs(F.log(F.greatest(F.col("_std") / F.col("_scale"), F.lit(1e-12))))
    rows = size.where("_valid >= 3").join(names, "series_id").join(trend, "series_id").join(far, "series_id").join(season, "series_id", "left")
    rows = rows.select("series_id", "_of", F.when(F.isnan("trend"), 0.0).otherwise(F.col("trend")).alias("trend"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("lag", F.lit(0)).alias("lag"), "outliers", ratio.alias("ratio"))
    first = F.max(F.struct("strength", F.expr("-coalesce(try_cast(element_at(split(series_id, '\t'), -1) as int), 0)").alias("o"), "lag"))["lag"]
    by = rows.groupBy("_of").agg(F.avg("trend").alias("trend_strength"), F.avg("strength").alias("seasonality_strength"), first.alias("best_lag"), F.avg("outliers").alias("outlier_rate"), F.avg("ratio").alias("scale_instability"))
    c = F.col
    return by.select(
        c("_of").alias("series_id"), (c("trend_strength") >= 0.25).alias("detrend"), F.when((c("seasonality_strength") >= 0.35) & (c("best_lag") >= 2), c("best_lag")).alias("difference_by"),
        (c("outlier_rate") >= 0.02).alias("winsorize"), (c("scale_instability") >= 0.35).alias("robust_scale"), "trend_strength", "seasonality_strength", "best_lag", "outlier_rate", "scale_instability",
    )
