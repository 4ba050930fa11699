"""Segment costs, prefix sums and robust statistics as Catalyst expressions over series frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cost_kernels import VAR_FLOOR


def SERIES():  # noqa: N802
    """The rows of a series. A function, since windows cannot be made before a session is."""
    return W.partitionBy("series_id")


def ORDERED():  # noqa: N802
    return SERIES().orderBy("t")


def RUN():  # noqa: N802
    return ORDERED().rowsBetween(W.unboundedPreceding, W.currentRow)


def dealt(s: DataFrame) -> DataFrame:
    """Rows by series in as many partitions as shuffles have; without a shuffle of its own where a window has dealt them so.

    Series cost far more time than bytes: for small inputs set spark.sql.adaptive.coalescePartitions.minPartitionSize to some
    kilobytes, so that adaptive execution does not merge their partitions into a few tasks.
    """
    return s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id")


def missing(x: str = "x") -> Column:
    return F.col(x).isNull() | F.isnan(x)


def valid_rows(s: DataFrame) -> DataFrame:
    return s.where(~missing())


def sampling_rate(s: DataFrame) -> DataFrame:
    """series_id, interval_us (the median of the positive gaps between neighbours' ts) and rate_hz; null without such gaps."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(ORDERED()))
    by = s.select("series_id", gap.alias("_g")).groupBy("series_id").agg(F.median(F.when(F.col("_g") > 0, F.col("_g"))).alias("interval_us"))
    return by.select("series_id", "interval_us", (1e6 / F.greatest("interval_us", F.lit(1e-9))).alias("rate_hz"))


def flatten_missing(s: DataFrame, mask: str) -> DataFrame:
    """One missing value: NaN or masked becomes null."""
    return s.withColumn("x", F.when(~((F.col(mask) == 1) | missing()), F.col("x")))


def stride_sample(s: DataFrame, stride: int) -> DataFrame:
    """Every stride-th row and the last one."""
    last = F.max("t").over(SERIES())
    return s.withColumn("_last", last).where((F.col("t") % stride == 0) | (F.col("t") == F.col("_last"))).drop("_last")


def running(s: DataFrame, sums: dict[str, Column], chunk: int | None = None) -> DataFrame:
    """Inclusive running sums by series. chunk: rows per window task for long series; totals of chunks are offset by a
    window over the few chunks, so that no series has to fit one task."""
    if chunk is None:
        return s.select("*", *[F.sum(c).over(RUN()).alias(k) for k, c in sums.items()])
    cut = s.withColumn("_c", F.floor(F.col("t") / chunk))
    inner = W.partitionBy("series_id", "_c").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = cut.groupBy("series_id", "_c").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = SERIES().orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("series_id", "_c", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    part = cut.select("*", *[F.sum(c).over(inner).alias(k) for k, c in sums.items()])
    return part.join(offsets, ["series_id", "_c"]).select(*s.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])


def prefixes(s: DataFrame, sums: dict[str, Column], chunk: int | None = None) -> DataFrame:
    """series_id, t = 0 .. n and the sums over the rows before t."""
    run = running(s.select("series_id", "t", *[c.alias(f"_v{i}") for i, c in enumerate(sums.values())]), {k: F.col(f"_v{i}") for i, k in enumerate(sums)}, chunk)
    after = run.select("series_id", (F.col("t") + 1).alias("t"), *sums)
    zero = s.select("series_id").distinct().select("series_id", F.lit(0).cast("long").alias("t"), *[F.lit(0).cast(run.schema[k].dataType).alias(k) for k in sums])
    return zero.unionByName(after)


def segment_sums(segments: DataFrame, prefix: DataFrame, names: list[str]) -> DataFrame:
    """segments (series_id, s, e) with m and the sums over [s, e): two lookups in the prefixes."""
    low = prefix.select("series_id", F.col("t").alias("s"), *[F.col(k).alias(f"_{k}") for k in names])
    high = prefix.select("series_id", F.col("t").alias("e"), *names)
    out = segments.join(low, ["series_id", "s"]).join(high, ["series_id", "e"])
    return out.select(*segments.columns, (F.col("e") - F.col("s")).alias("m"), *[(F.col(k) - F.col(f"_{k}")).alias(k) for k in names])


def l2(m: Column, a: Column, b: Column) -> Column:
    return F.greatest(b - a * a / m, F.lit(0.0))


def normal(m: Column, a: Column, b: Column) -> Column:
    var = b / m - (a / m) * (a / m)
    return m * F.log(F.greatest(var, F.lit(VAR_FLOOR)))


def poisson(m: Column, a: Column) -> Column:
    return F.when(a > 0, a - a * F.log(a / m)).otherwise(F.lit(0.0))


def bernoulli(m: Column, k: Column) -> Column:
    p = k / m
    return F.when((k > 0) & (k < m), -(k * F.log(p) + (m - k) * F.log(1 - p))).otherwise(F.lit(0.0))


def linear(m: Column, a: Column, b: Column, ta: Column, s: Column) -> Column:
    u = m * (m - 1) / 2
    sxx = (m - 1) * m * (2 * m - 1) / 6 - u * u / m
    sxy = ta - s * a - u * a / m
    syy = b - a * a / m
    return F.when(m <= 1, F.lit(0.0)).otherwise(F.greatest(syy - F.try_divide(sxy * sxy, sxx), F.lit(0.0)))


def nig(m: Column, a: Column, b: Column, lgamma: Column, kappa: float = 0.01) -> Column:
    """Less the log marginal likelihood under the prior mean 0, strength kappa, shape and scale 1; lgamma: of 1 + m / 2."""
    mean, kn = a / m, m + kappa
    scale = 1 + 0.5 * F.greatest(b - a * mean, F.lit(0.0)) + kappa * m * mean * mean / (2 * kn)
    return -(lgamma - (1 + m / 2) * F.log(scale) + 0.5 * (F.lit(math.log(kappa)) - F.log(kn)) - 0.5 * m * math.log(2 * math.pi))


def lgamma_table(spark: SparkSession, longest: int) -> DataFrame:
    """m and lgamma(1 + m / 2) for segments of up to `longest` rows: as small as the segments are short."""
    return spark.createDataFrame([(k, math.lgamma(1 + k / 2)) for k in range(1, longest + 1)], "m bigint, lgamma double")


def full_cov_2d(m: Column, a: Column, u: Column, b: Column, v: Column, w: Column) -> Column:
    """m times the log determinant of the ridged covariance of two columns x and y, from the sums of x, y, x^2, y^2, x * y."""
    xx, yy, xy = b / m - (a / m) * (a / m), v / m - (u / m) * (u / m), w / m - (a / m) * (u / m)
    ridge = F.greatest(1e-6 * (xx + yy) / 2, F.lit(VAR_FLOOR)) * F.when(m < 2, 1 + (2 - m) / 2).otherwise(F.lit(1.0))
    return m * F.log((xx + ridge) * (yy + ridge) - xy * xy)


def cosine(m: Column, sums: list[Column]) -> Column:
    """m less the length of the sum of m unit vectors."""
    length = F.sqrt(sum((c * c for c in sums[1:]), sums[0] * sums[0]))
    return F.greatest(m - length, F.lit(0.0))


def unit(columns: list[Column]) -> list[Column]:
    """The columns of a row as those of a vector of length 1; of a row of zeros, zeros."""
    norm = F.sqrt(sum((c.cast("double") * c for c in columns[1:]), columns[0].cast("double") * columns[0]))
    return [F.when(norm > 0, c / norm).otherwise(F.lit(0.0)) for c in columns]


def ar1(r: Column, a: Column, b: Column, u: Column, v: Column, w: Column) -> Column:
    """r pairs; sums of x, x^2, lag, lag^2, x * lag over them."""
    sxx, sxy, syy = v - u * u / r, w - u * a / r, b - a * a / r
    sse = F.when(sxx > 0, syy - sxy * sxy / F.when(sxx > 0, sxx)).otherwise(syy)
    return F.when(r <= 1, F.lit(0.0)).otherwise(r * F.log(F.greatest(F.greatest(sse, F.lit(0.0)) / F.when(r > 0, r), F.lit(VAR_FLOOR))))


def mid_rank(s: DataFrame, name: str = "r2") -> DataFrame:
    """Twice the mid rank, which is whole: ties share the mean of their places."""
    place = F.rank().over(SERIES().orderBy("x"))
    same = F.count(F.lit(1)).over(W.partitionBy("series_id", "x"))
    return s.withColumn(name, 2 * place + same - 1)


def _dot(p, q, f=lambda a, b: a * b):
    return F.aggregate(F.zip_with(p, q, lambda a, b: f(a.cast("double"), b.cast("double"))), F.lit(0.0), lambda acc, z: acc + z)


def tiles(s: DataFrame, keys: list[str], size: int = 64) -> DataFrame:
    """keys, b, c and the rows (structs of t and x) of blocks b <= c of each group, for all pairs of blocks of `size` rows.

    A block meets another under the key (group, b, c), which holds just these two, so that no task gets a whole group; a row is
    sent once for each block of its group instead of once for each row. Rows are t apart from the first of their group.
    """
    least = s.groupBy(*keys).agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    block = F.floor((F.col("t") - F.col("_low")) / size)
    rows = s.join(least, keys).groupBy(*keys, block.alias("b")).agg(F.collect_list(F.struct("t", "x")).alias("_rows"), F.max(F.floor((F.col("_high") - F.col("_low")) / size)).alias("_last"))
    left = rows.select(*keys, "b", F.explode(F.sequence("b", "_last")).alias("c"), F.col("_rows").alias("_p"))
    right = rows.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "b")).alias("b"), F.col("b").alias("c"), F.col("_rows").alias("_q"))
    return left.join(right, [*keys, "b", "c"])


def gram(s: DataFrame, keys: tuple = ("series_id",), size: int = 64, gamma: float | None = None) -> DataFrame:
    """keys, i, j and g for all pairs of rows i <= j of each group; x is an array. g is the dot product, or with gamma the
    radial kernel exp(-gamma * squared distance)."""
    pairs = tiles(s, list(keys), size).select(*keys, "b", "c", F.explode("_p").alias("p"), "_q").select(*keys, "p", F.explode("_q").alias("q")).where("p.t <= q.t")
    g = _dot(F.col("p.x"), F.col("q.x")) if gamma is None else F.exp(-gamma * _dot(F.col("p.x"), F.col("q.x"), lambda a, b: (a - b) * (a - b)))
    return pairs.select(*keys, F.col("p.t").alias("i"), F.col("q.t").alias("j"), g.alias("g"))


def kernel_costs(s: DataFrame, gamma: float | None = None, size: int = 64) -> DataFrame:
    """series_id, k, m and cost of each segment k of rows (series_id, k, t, x): the kernel's diagonal less the mean of its block.

    The block's sum comes from the sums of its tiles, which combine map-side; a tile off the diagonal counts twice.
    """
    g = gram(s, ("series_id", "k"), size, gamma)
    sums = g.groupBy("series_id", "k").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("g"))).alias("diagonal"), F.sum(F.when(F.col("i") == F.col("j"), F.col("g")).otherwise(2 * F.col("g"))).alias("whole"), F.count_if(F.col("i") == F.col("j")).alias("m"))
    return sums.select("series_id", "k", "m", F.greatest(F.col("diagonal") - F.col("whole") / F.col("m"), F.lit(0.0)).alias("cost"))


def log_sum_exp(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """The logarithm of a group's summed exponentials, shifted by the greatest value, in two passes.

    NaN makes the result NaN; without it, an infinite value makes it infinite; values that are all minus infinity give minus
    infinity; a group without values, whose x are null, gives minus infinity too.
    """
    top = df.groupBy(*keys).agg(F.max(x).alias("_top"))  # NaN is the greatest
    shift = F.when(F.abs("_top") < float("inf"), F.col("_top")).otherwise(F.lit(0.0))
    total = F.sum(F.exp(F.col(x) - shift))
    at = F.first("_top")
    value = F.when(at.isNull(), F.lit(float("-inf"))).when(F.isnan(at) | (F.abs(at) == float("inf")), at).otherwise(at + F.log(total))
    return df.join(top, keys).groupBy(*keys).agg(value.alias(name))


def log_add_exp(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b)); NaN if either is, and the other one where one is minus infinity."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(F.isnan(high) | (F.abs(high) == float("inf")), high).otherwise(high + F.log1p(F.exp(low - high)))


def mad(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """median, and the median absolute deviation from it (unscaled)."""
    med = df.groupBy(*keys).agg(F.median(x).alias("med"))
    return df.join(med, keys).groupBy(*keys).agg(F.first("med").alias("med"), F.median(F.abs(F.col(x) - F.col("med"))).alias("mad"))
