"""Canonical series frames: series_id, t (0 based, dense), ts, x and, for exact sums, x_fp (x in hundredths)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scan import numbered


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(df: DataFrame, key, order: list, value, scale: int = 100, ts=None, long: bool = False) -> DataFrame:
    """Number the rows of each series and add the fixed-point value; NaN counts as missing. long: the series are longer than
    one task should sort, and are numbered by ranges."""
    x = F.when(~F.isnan(value), value)
    named = df.withColumn("series_id", key.cast("string"))
    t = F.row_number().over(W.partitionBy("series_id").orderBy(*order)) - 1
    out = (numbered(named, "series_id", order) if long else named.withColumn("t", t.cast("long"))).withColumn("x", x)
    return out.select("series_id", "t", (ts if ts is not None else F.lit(None)).alias("ts"), "x", F.round(F.col("x") * scale).cast("long").alias("x_fp"))


def events(spark: SparkSession, sf_dir: str, by: str = "event_type", long: bool = False) -> DataFrame:
    df = read(spark, sf_dir, "events").select(by, "ts", "event_id", "value")
    return series(df, F.col(by), ["ts", "event_id"], F.col("value"), ts=F.col("ts"), long=long)


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantities of all line items as one series, which grows with the table."""
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return series(df, F.lit("lineitem"), ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity"], F.col("l_quantity"), ts=F.col("l_shipdate"), long=True)


def error_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return series(df, F.col("user_id"), ["ts", "event_id"], (F.col("event_type") == "error").cast("double"), scale=1, ts=F.col("ts"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return series(df, F.lit("orders"), ["day"], F.col("n").cast("double"), scale=1, ts=F.col("day"))


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns per ship date: rows, quantity and price, as x array."""
    df = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
    df = df.agg(F.count(F.lit(1)).cast("double").alias("a"), F.sum("l_quantity").alias("b"), F.sum((F.col("l_extendedprice") * 100).cast("long")).cast("double").alias("c"))
    t = (F.row_number().over(W.partitionBy("series_id").orderBy("day")) - 1).cast("long")
    return df.withColumn("series_id", F.lit("lineitem")).withColumn("t", t).select("series_id", "t", F.col("day").alias("ts"), F.array("a", "b", "c").alias("x"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings").withColumn("series_id", F.lit("embeddings"))
    t = (F.row_number().over(W.partitionBy("series_id").orderBy("vec_id")) - 1).cast("long")
    return df.withColumn("t", t).select("series_id", "t", F.col("embedding").alias("x"))


def with_gaps(s: DataFrame, kind: str = "scattered") -> DataFrame:
    """Missing values: every 17th row (scattered), rows 40 to 59 (block) or every tenth row (periodic)."""
    hit = {"scattered": F.col("t") % 17 == 3, "block": F.col("t").between(40, 59), "periodic": F.col("t") % 10 == 0}[kind]
    return s.withColumn("x", F.when(~hit, F.col("x"))).withColumn("x_fp", F.when(~hit, F.col("x_fp")))
