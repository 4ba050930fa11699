"""Registered queries return a row for every row of a series, and not for its beginning only."""

import math

import duckdb
from pyspark.sql import functions as F

from driftline.queries import costs, detectors, streams
from driftline.sources import tables as T

SMOKE = "/root/testdata/sf0.001"


def bernoulli_posterior(x: list[float], rate: float) -> list[float]:
    """p_change of each row by the recursion over all run lengths, in probabilities and without pruning."""
    mass, ones, seen, out = [1.0], [0], [0], []
    for v in x:
        grown = [m * (1 - rate) * ((1 + k) if v == 1 else (1 + n - k)) / (2 + n) for m, k, n in zip(mass, ones, seen, strict=True)]
        mass = [sum(mass) * rate * 0.5, *grown]
        total = math.fsum(mass)
        mass = [m / total for m in mass]
        ones, seen = [v, *[k + v for k in ones]], [1, *[n + 1 for n in seen]]
        out.append(mass[0])
    return out


def test_bocpd_bernoulli_covers_whole_series(spark, tmp_path):
    draws = [(e, i % 2, "error" if (e * 7 + i) % (3 if e > 60 else 9) == 0 else "view") for e in range(95) for i in range(2)]
    rows = spark.createDataFrame(draws, "event_id long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds(F.col("event_id"))).withColumn("value", F.lit(1.0))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["series_id"], r["t"]): r["p_change"] for r in detectors.bocpd_bernoulli(spark, str(tmp_path)).collect()}
    assert len(got) == len(draws)
    for user in (0, 1):
        expected = bernoulli_posterior([float(kind == "error") for _, u, kind in draws if u == user], 1 / 200)
        assert all(abs(got[str(user), t] - p) < 2e-6 for t, p in enumerate(expected))


def test_stream_bocpd_late_covers_whole_series(spark, tmp_path):
    rows = spark.range(150).select(F.col("id").alias("event_id"), (F.col("id") % 2).alias("user_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("view").alias("event_type"), (F.col("id") % 7).cast("double").alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert streams.stream_bocpd_late(spark, str(tmp_path)).count() == 150


def test_flatten_missing_covers_whole_series(spark):
    got = costs.flatten_missing(spark, SMOKE)
    assert got.count() == T.events(spark, SMOKE).count() > 5 * 60
    assert got.where("t >= 60").where(F.col("x").isNull() != (F.col("t") % 9 == 4)).count() == 0


def test_pelt_manual_jump_tries_every_row(spark, tmp_path):
    draws = [(e, i, 1000.0 if e >= at else 0.0) for i, at in enumerate((7, 11, 18)) for e in range(24)]
    rows = spark.createDataFrame(draws, "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    query, sql = detectors.QUERIES["pelt_manual_jump"]
    got = sorted((r["series_id"], r["change_points"]) for r in query(spark, str(tmp_path)).collect())
    assert got == [("0", "7"), ("1", "11"), ("2", "18")]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert sorted((r[0], r[3]) for r in con.execute(sql).fetchall()) == got
