"""Streams of long series: several batches in the order of arrival, and output in pieces."""

import json

import pandas as pd
from pyspark.sql import functions as F

from driftline.queries import streams
from driftline.streaming import processors


class Kept:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_long_series_comes_out_in_pieces():
    p = processors.DetectorProcessor("page_hinkley", {"delta": 1.0, "threshold": 50.0}, "arrival_seq", False)
    p.state = Kept()
    n = 25_000
    frame = pd.DataFrame({"series_id": "a", "arrival_seq": range(n), "x": [float(i * i % 97) for i in range(n)]})
    shuffled = frame.sample(frac=1.0, random_state=3)
    out = list(p.handleInputRows(("a",), iter([shuffled.iloc[:9000], shuffled.iloc[9000:]]), None))
    assert max(map(len, out)) <= 10_000
    assert pd.concat(out)["t"].tolist() == list(range(n))
    assert json.loads(p.state.get()[0])["t"] == n
    assert list(p.handleInputRows(("a",), iter([frame.iloc[:10]]), None))[0]["t"].tolist() == list(range(n, n + 10))


def test_batches_follow_the_order_of_arrival(spark, tmp_path, monkeypatch):
    ids = spark.range(3000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1).alias("user_id"))
    ids = ids.withColumn("event_type", F.when(F.col("event_id") % 3 == 0, "view").otherwise("click")).withColumn("value", (F.col("event_id") * 37 % 101).cast("double"))
    ids.write.parquet(f"{tmp_path}/events.parquet")
    run = lambda: sorted(map(tuple, streams.stream_page_hinkley(spark, str(tmp_path)).collect()))
    whole, ran = run(), []
    monkeypatch.setattr(streams, "SERIES_ROWS", 300)
    monkeypatch.setattr(streams.S, "run_available", lambda *args, own=processors.run_available: ran.append(own(*args)))
    assert run() == whole and len(whole) == 3000
    assert len(ran[0].batch_ms) == 7 and ran[0].rows == 3000
