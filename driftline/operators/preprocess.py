"""Preprocessing of series as plans, in the fixed order detrend, deseasonalize, winsorize, robust scale."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..errors import InvalidInput
from ..functions.native import ORDERED, SERIES, mad, missing

STEPS = ("detrend", "deseasonalize", "winsorize", "robust_scale")


def detrend_linear(s: DataFrame) -> DataFrame:
    """x less its least-squares line over the valid rows; series with fewer than two stay as they are."""
    t = F.when(~missing(), F.col("t").cast("double"))
    fit = s.groupBy("series_id").agg(F.regr_slope("x", t).alias("slope"), F.regr_intercept("x", t).alias("icept"), F.count(t).alias("valid"))
    line = F.when(F.col("valid") >= 2, F.coalesce("icept", F.lit(0.0)) + F.coalesce("slope", F.lit(0.0)) * F.col("t")).otherwise(F.lit(0.0))
    return s.join(fit, "series_id").withColumn("x", F.col("x") - line).select(*s.columns)


def detrend_polynomial(s: DataFrame, degree: int) -> DataFrame:
    """x less its least-squares polynomial of degree 1 to 3: power sums are aggregated, a small system per series is solved."""
    if degree not in (1, 2, 3):
        raise InvalidInput(f"the degree must be 1, 2 or 3; got {degree}")
    scale = F.max("t").over(SERIES()).cast("double")
    u = F.when(F.col("_top") > 0, F.col("t") / F.col("_top")).otherwise(F.lit(0.0))
    rows = s.withColumn("_top", scale).withColumn("_u", u)
    own = rows.where(~missing())
    powers = own.groupBy("series_id").agg(*[F.sum(F.pow("_u", F.lit(k))).alias(f"p{k}") for k in range(2 * degree + 1)], *[F.sum(F.col("x") * F.pow("_u", F.lit(k))).alias(f"q{k}") for k in range(degree + 1)])

    def solve(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                m = np.array([[getattr(row, f"p{i + j}") for j in range(degree + 1)] for i in range(degree + 1)])
                v = np.array([getattr(row, f"q{i}") for i in range(degree + 1)])
                out.append((row.series_id, np.linalg.lstsq(m, v, rcond=None)[0].tolist() if row.p0 > degree else [0.0] * (degree + 1)))
            yield pd.DataFrame(out, columns=["series_id", "c"])

    fit = powers.mapInPandas(solve, "series_id string, c array<double>")
    curve = sum((F.col("c")[k] * F.pow("_u", F.lit(k)) for k in range(1, degree + 1)), F.col("c")[0])
    return rows.join(fit, "series_id").withColumn("x", F.col("x") - curve).select(*s.columns)


def _longer(s: DataFrame, period: int, what: str) -> DataFrame:
    """s with _n, the length of its series; a series that is not longer than the period is an error."""
    n = F.count(F.lit(1)).over(SERIES())
    why = F.concat(F.lit(f"{what} needs a period below the length of the series; the period is {period}, the length "), n.cast("string"))
    return s.withColumn("_n", F.when(n > period, n).otherwise(F.raise_error(why).cast("long")))


def difference(s: DataFrame, period: int) -> DataFrame:
    """x less x one period before; the first period stays; missing if either side is."""
    if period < 1:
        raise InvalidInput("the period must be at least 1")
    rows = _longer(s, period, "differencing")
    x = F.when(F.col("t") < period, F.col("x")).otherwise(F.col("x") - F.lag("x", period).over(ORDERED()))
    return rows.withColumn("x", F.when(F.col("_n") > 0, x)).select(*s.columns)


def moving_average(half: int, x: str = "x"):
    """Mean of the valid values of a centred window, cut at the ends."""
    return F.avg(x).over(ORDERED().rowsBetween(-half, half))


def stl_like(s: DataFrame, period: int, rounds: int = 2, short: str = "error") -> DataFrame:
    """x less a season that is re-estimated from what a moving average leaves; the trend stays in.

    short: error stops at a series that is not longer than the period; keep treats it by the same rule, in which each of its
    phases has one row, so that it cannot fail the others.
    The window of the average is 2 * period + 1 rows, or the largest odd number of rows that a shorter series has, 3 at least.
    Frames have one width in a plan: places of short series are stretched, so that the same distance spans fewer of their rows.
    A phase without values has the mean 0.
    """
    if period < 2:
        raise InvalidInput("the period must be at least 2")
    if short not in ("error", "keep"):
        raise InvalidInput(f"short series are an error or kept; got {short!r}")
    rows = _longer(s, period, "a season") if short == "error" else s.withColumn("_n", F.count(F.lit(1)).over(SERIES()))
    odd = F.col("_n") - (F.col("_n") % 2 == 0).cast("int")
    half = F.floor(F.greatest(F.lit(3), F.least(F.lit(2 * period + 1), odd)) / 2)
    rows = rows.withColumn("_place", F.col("t") * (F.lit(float(period)) / half)).withColumn("_season", F.lit(0.0)).withColumn("_phase", F.col("t") % period)
    phase = W.partitionBy("series_id", "_phase")
    near = f"over (partition by series_id order by _place range between {period}.5D preceding and {period}.5D following)"
    for _ in range(rounds):
        rows = rows.withColumn("_clean", F.col("x") - F.col("_season")).withColumn("_rest", F.col("x") - F.expr(f"avg(_clean) {near}"))
        rows = rows.withColumn("_mean", F.coalesce(F.avg("_rest").over(phase), F.lit(0.0)))
        # Each phase's mean stands once: in its first row.
        level = F.sum(F.when(F.col("t") < period, F.col("_mean"))).over(SERIES()) / period
        rows = rows.withColumn("_season", F.col("_mean") - level)
    return rows.withColumn("x", F.col("x") - F.col("_season")).select(*s.columns)


def winsorize(s: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """x clamped to nearest-rank quantiles of its series."""
    if not 0 <= low < high <= 1:
        raise InvalidInput("winsorize needs 0 <= low < high <= 1")
    own = s.where(~missing())
    cut = own.groupBy("series_id").agg(F.expr(f"percentile_disc({low}) WITHIN GROUP (ORDER BY x)").alias("_lo"), F.expr(f"percentile_disc({high}) WITHIN GROUP (ORDER BY x)").alias("_hi"))
    return s.join(cut, "series_id", "left").withColumn("x", F.when(~missing(), F.least(F.greatest("x", "_lo"), F.col("_hi")))).select(*s.columns)


def robust_scale(s: DataFrame, factor: float = 1.4826, least: float = 1e-9) -> DataFrame:
    """(x - median) / max(factor * MAD, least)."""
    stats = mad(s.where(~missing()), ["series_id"])
    return s.join(stats, "series_id", "left").withColumn("x", (F.col("x") - F.col("med")) / F.greatest(F.lit(factor) * F.col("mad"), F.lit(least))).select(*s.columns)


def forward_fill(s: DataFrame) -> DataFrame:
    """Missing values take the last valid one; leading ones are 0."""
    x = F.when(~missing(), F.col("x"))
    return s.withColumn("x", F.coalesce(F.last(x, ignorenulls=True).over(ORDERED().rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))


def preprocess(s: DataFrame, config: dict | None) -> DataFrame:
    """config maps steps to their options; the order is fixed, unknown keys are refused. Series with several columns (x as an
    array) are treated column by column and come back as series_id, t and x."""
    config = config or {}
    unknown = set(config) - set(STEPS)
    if unknown:
        raise InvalidInput(f"unknown preprocessing step {sorted(unknown)[0]!r}")
    if config and isinstance(s.schema["x"].dataType, ArrayType):
        each = s.select(F.col("series_id").alias("_of"), "t", F.posexplode("x").alias("_dim", "x"))
        each = each.select(F.concat_ws("\t", "_of", "_dim").alias("series_id"), "t", F.col("x").cast("double").alias("x"), "_of", "_dim")
        back = preprocess(each, config).groupBy("_of", "t").agg(F.array_sort(F.collect_list(F.struct("_dim", "x"))).alias("_all"))
        return back.select(F.col("_of").alias("series_id"), "t", F.transform("_all", lambda e: e["x"]).alias("x"))
    if (c := config.get("detrend")) is not None:
        s = detrend_linear(s) if c.get("method", "linear") == "linear" else detrend_polynomial(s, int(c.get("degree", 2)))
    if (c := config.get("deseasonalize")) is not None:
        s = difference(s, int(c["period"])) if c.get("method", "differencing") == "differencing" else stl_like(s, int(c["period"]))
    if (c := config.get("winsorize")) is not None:
        s = winsorize(s, c.get("lower_quantile", 0.01), c.get("upper_quantile", 0.99))
    if (c := config.get("robust_scale")) is not None:
        s = robust_scale(s, c.get("mad_epsilon_factor", 1.4826))
    return s
