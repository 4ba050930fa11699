"""Profiles search the reference's ranges, and count the rows of whole series."""

import math

from pyspark.sql import functions as F

from driftline.operators import diagnostics as P


def test_periods_up_to_the_largest_lag(spark):
    rows = [("a", t, None, math.sin(2 * math.pi * t / 100) + 0.01 * (t * 7919 % 13)) for t in range(700)]
    s = spark.createDataFrame(rows, "series_id string, t long, ts timestamp, x double")
    assert P.diagnostics(s).first()["period"] == 100
    # Half a period away the series is its own opposite: the size of the correlation counts, and there it is the largest.
    assert P.preprocessing_advice(s).first()["difference_by"] == 50
    short = P.diagnostics(s.where("t < 60")).first()
    # Up to lag 15 the values only fall: without a peak all of them stand for one, and the smallest lag near the top is taken.
    assert short["period"] == 2 and short["regime_change_proxy"] == 0.0


def test_rows_and_gaps_of_long_series_are_counted_before_the_sample(spark, monkeypatch):
    monkeypatch.setattr(P, "SUBSAMPLE_ABOVE", 1000)
    monkeypatch.setattr(P, "SUBSAMPLE_TO", 500)
    x = F.when(~F.col("t").between(100, 129), F.col("t") * 7919 % 101).cast("double")
    s = spark.range(2000).select(F.lit("a").alias("series_id"), F.col("id").alias("t"), F.lit(None).cast("timestamp").alias("ts")).withColumn("x", x)
    got = P.diagnostics(s).first()
    assert got["used_subsampling"] and (got["n"], got["missing"], got["longest"], got["pattern"]) == (2000, 30, 30, "block")
