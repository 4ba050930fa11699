"""Users' series of any length keep their rows, the same as the SQL has them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline.queries import costs
from driftline.sources import tables as T


def test_series_shorter_than_the_period_are_deseasonalized(spark, tmp_path):
    sizes = {1: 1, 2: 2, 3: 5, 4: 36, 5: 37, 6: 90}
    rows = [(i, user, float((7 * i + i * i) % 101) / 4) for user, n in sizes.items() for i in range(1000 * user, 1000 * user + n)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    events = events.withColumn("ts", F.timestamp_seconds("event_id")).withColumn("event_type", F.lit("view"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    query, sql = costs.QUERIES["deseasonalize_short"]
    got = {(r["series_id"], r["t"]): r["x"] for r in query(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = {(s, t): x for s, t, x in con.execute(sql).fetchall()}
    assert got.keys() == want.keys() and len(got) == sum(sizes.values())
    for k, x in want.items():
        assert got[k] is None if x is None else got[k] == pytest.approx(x, abs=2e-5)
    assert T.events(spark, str(tmp_path), "user_id").count() == len(got)
