"""Synthetic series with known change points, as plans over a range. Draws are seeded per row, so partitions do not matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput


def even_change_points(n: int, k: int) -> list[int]:
    """k points at i * n / (k + 1)."""
    return [i * n // (k + 1) for i in range(1, k + 1)]


def uniform(seed: int, salt: int) -> Column:
    """A number in (0, 1) from the row's series and place."""
    return (F.pmod(F.xxhash64("series_id", "t", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def gaussian(seed: int, salt: int = 0) -> Column:
    """Box-Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, 2 * salt))) * F.cos(2 * math.pi * uniform(seed, 2 * salt + 1))


def _grid(spark: SparkSession, series: int, n: int, k: int) -> DataFrame:
    cps = F.lit(even_change_points(n, k)).cast("array<bigint>") if k else F.array().cast("array<bigint>")
    base = spark.range(series * n).select((F.col("id") / n).cast("long").cast("string").alias("series_id"), (F.col("id") % n).alias("t"), F.lit(n).cast("long").alias("n"))
    return base.withColumn("seg", F.size(F.filter(cps, lambda c: c <= F.col("t"))))


def generate(spark: SparkSession, kind: str, series: int = 1, n: int = 300, k: int = 2, seed: int = 0, noise: float = 1.0, jump: float = 3.0, phi: float = 0.6, dims: int = 3, dof: int = 3) -> DataFrame:
    """series_id, t, x (an array for the correlated kind). Kinds: mean, variance, linear, ar1, heavy_tail, poisson,
    bernoulli, correlated."""
    rows = _grid(spark, series, n, k)
    level = jump * F.col("seg")
    if kind == "mean":
        x = level + noise * gaussian(seed)
    elif kind == "variance":
        x = noise * F.pow(F.lit(1 + jump), F.col("seg") % 2) * gaussian(seed)
    elif kind == "linear":
        x = F.when(F.col("seg") % 2 == 0, F.col("t")).otherwise(-F.col("t")) * (jump / n) + noise * gaussian(seed)
    elif kind == "ar1":
        # A finite moving average of the same draws: phi^40 is below the noise of any use here.
        own = rows.withColumn("e", noise * gaussian(seed))
        from pyspark.sql import Window as W

        lags = sum((F.coalesce(F.lag("e", j).over(W.partitionBy("series_id").orderBy("t")), F.lit(0.0)) * phi**j for j in range(1, 41)), F.col("e"))
        return own.withColumn("x", level + lags).select("series_id", "t", "x")
    elif kind == "heavy_tail":
        chi = sum((gaussian(seed, j) * gaussian(seed, j) for j in range(1, dof + 1)), F.lit(0.0))
        x = level + noise * gaussian(seed) / F.sqrt(chi / dof)
    elif kind == "poisson":
        rate = F.lit(2.0) + level
        # The count is the number of partial products of the Poisson series that the draw exceeds.
        acc = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))
        fold = lambda a, j: F.struct((a["p"] * rate / j).alias("p"), (a["c"] + a["p"] * rate / j).alias("c"), (a["k"] + (uniform(seed, 0) > a["c"]).cast("int")).alias("k"))
        x = F.aggregate(F.sequence(F.lit(1), F.lit(60)), acc, fold)["k"].cast("double")
    elif kind == "bernoulli":
        x = (uniform(seed, 0) < F.when(F.col("seg") % 2 == 0, 0.2).otherwise(0.8)).cast("double")
    elif kind == "correlated":
        shared = gaussian(seed, 0)
        x = F.array(*[level * (1 if j % 2 == 0 else -1) + noise * (phi * shared + math.sqrt(1 - phi * phi) * gaussian(seed, j + 1)) for j in range(dims)])
    else:
        raise InvalidInput(f"unknown generator {kind!r}")
    return rows.withColumn("x", x).select("series_id", "t", "x")


def truth(spark: SparkSession, series: int, n: int, k: int) -> DataFrame:
    """The generated change points: series_id, cp."""
    return spark.range(series).select(F.col("id").cast("string").alias("series_id"), F.explode(F.lit(even_change_points(n, k)).cast("array<bigint>")).alias("cp")) if k else spark.createDataFrame([], "series_id string, cp bigint")


#: Name, kind, length, change points: what `dataset` makes.
REGISTRY = [(f"{kind}_{n}", kind, n, k) for kind, n, k in (("mean", 300, 2), ("variance", 320, 2), ("linear", 240, 1), ("ar1", 400, 3), ("heavy_tail", 300, 2), ("poisson", 300, 2), ("bernoulli", 320, 3), ("correlated", 300, 2), ("mean", 400, 4), ("variance", 400, 3))]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, even_change_points(r[2], r[3])) for r in REGISTRY], "name string, kind string, n bigint, k bigint, change_points array<bigint>")


def dataset(spark: SparkSession, name: str, series: int = 1, seed: int = 0) -> DataFrame:
    row = next((r for r in REGISTRY if r[0] == name), None)
    if row is None:
        raise InvalidInput(f"unknown dataset {name!r}")
    return generate(spark, row[1], series, row[2], row[3], seed)
