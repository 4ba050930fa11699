"""Short series that are taken together have the results that each has by itself, and those of the SQL where segmentations tie."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.config import Constraints, Stopping
from driftline.errors import EngineError
from driftline.operators import short_series as G
from driftline.operators.offline_kernels import detect
from driftline.queries import detectors

#: A series in hundredths of which two segmentations cost the same.
TIED = [3874, 4139, 18297, 421, 13179, 2197, 2342, 3276, 318, 7631, 3286, 12530, 271, 508, 599, 2841, 2869, 4337, 15911, 1287]
TIED += [1452, 11497, 3687, 641, 9105, 6079, 1186, 2165, 3169, 1861, 8534, 378, 9709, 2287, 4844, 1551, 1033, 22081, 1766, 4887]
TIED += [522, 4766, 5343, 11339, 1062, 391, 4825, 7607, 1168, 7653, 2811, 42, 78, 4471, 9359, 3715, 1328, 4235, 4887]


def some_series(seed: int, sizes) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.round(rng.exponential(50, n), 2)[:, None] for n in sizes]


def compared(xs, *run, **more):
    """The outcomes of series taken together, each checked against the series' own."""
    assert G.together(*run[:2], run[2], run[3], "balanced", None, more.get("cost_options"))
    for x, got in zip(xs, G.detect_many(xs, *run, **more), strict=True):
        try:
            own = detect(x, *run, **more)
        except EngineError as e:
            assert type(got) is type(e) and str(got) == str(e)
            continue
        assert got.breakpoints == own.breakpoints and got.warnings == own.warnings
        assert got.objective == pytest.approx(own.objective, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("name", ["pelt_l2", "fpop_l2"])
def test_ties_are_those_of_the_sql(spark, tmp_path, name):
    rows = [(i, i % 2, v / 100) for i, v in enumerate(v for v in TIED for _ in range(2))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    events.withColumn("event_type", F.lit("view")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    query, sql = detectors.QUERIES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(con.execute(sql).fetchall())


def test_penalized_series_as_each_by_itself():
    xs = some_series(1, [1, 2, 3, 4, 5, 60, 61, 7, 90, 33, 600]) + [np.full((20, 1), 3.3), np.zeros((5, 1))]
    for m, pen in ((2, "bic"), (4, 9000.0), (1, "aic")):
        compared(xs, "pelt", "l2", Stopping.of({"pen": pen}), Constraints(min_segment_len=m))
    compared([np.round(x * 100) for x in xs], "fpop", "l2", Stopping.of(None), Constraints(), cost_options={"scale": 100.0})


def test_known_numbers_of_change_points_as_each_by_itself():
    xs = some_series(2, [2, 3, 4, 5, 9, 60, 61, 30, 90, 33, 75, 44, 12]) + [np.full((20, 1), 3.3), np.zeros((5, 1))]
    xs += [np.concatenate([np.zeros((9, 1)), np.full((9, 1), 5.0), np.zeros((9, 1))])]  # no penalty gives one change point
    for m, k in ((2, 1), (2, 2), (3, 4), (1, 3)):
        compared(xs, "pelt", "l2", Stopping.known(k), Constraints(min_segment_len=m))


def test_absolute_deviations_as_each_by_itself():
    xs = some_series(3, [1, 2, 3, 4, 5, 60, 61, 7, 90]) + [np.round(x / 40) for x in some_series(4, [40, 70])] + [np.full((20, 1), 3.3)]
    for m, rule in ((2, "bic"), (4, 40.0), (1, "aic")):
        compared(xs, "pelt", "l1", Stopping.of({"pen": rule}), Constraints(min_segment_len=m))
    compared([x for x in xs if len(x) < 8], "pelt", "l1", Stopping.known(1), Constraints())


def test_autoregressions_as_each_by_itself():
    xs = some_series(5, [1, 5, 6, 7, 8, 11, 12, 13, 40, 61, 33]) + [np.full((30, 1), 3.25), np.zeros((14, 1))]
    for m, p, rule in ((6, 2, "bic"), (2, 2, "aic"), (6, 3, 4.0)):
        compared(xs, "pelt", "ar", Stopping.of({"pen": rule}), Constraints(min_segment_len=m), cost_options={"p": p})
    assert not G.together("pelt", "ar", Stopping.of(None), Constraints(), "balanced", None, {"p": 1})
