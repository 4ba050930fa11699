"""Online detectors over whole series: window plans where a closed form exists, grouped kernels for the rest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.native import ORDERED, RUN, running
from ..functions.scan import running_low
from .grouped import by_series
from .online_kernels import Gate, make_online

STEPS = "series_id string, t bigint, p_change double, alert boolean, alert_reason string, run_length_mode bigint, run_length_mean double"


def _scored(run: DataFrame, score, threshold: float) -> DataFrame:
    out = run.withColumn("score", score)
    return out.select("series_id", "t", "score", F.least(F.greatest(F.col("score") / threshold, F.lit(0.0)), F.lit(1.0)).alias("p_change"))


def _walk(s: DataFrame, step, chunk: int | None) -> DataFrame:
    """s with run, the running sum of step, and low, the least one so far; by chunks for long series."""
    if chunk is not None:
        return running_low(s, step, chunk)
    return s.withColumn("run", F.sum(step).over(RUN())).withColumn("low", F.min("run").over(RUN()))


def cusum(s: DataFrame, drift: float = 0.0, threshold: float = 8.0, target: float = 0.0, scale: float = 100.0, chunk: int | None = None) -> DataFrame:
    """One-sided CUSUM in closed form: the running sum less its lowest value so far (and 0). Whole-number sums."""
    step = F.col("x_fp") - F.lit(round(target * scale)) - F.lit(round(drift * scale))
    return _scored(_walk(s, step, chunk), (F.col("run") - F.least(F.lit(0), F.col("low"))) / scale, threshold)


def page_hinkley(s: DataFrame, delta: float = 0.01, threshold: float = 8.0, chunk: int | None = None) -> DataFrame:
    """Page-Hinkley as two stacked scans: the running mean, then the sum of deviations less its lowest value so far."""
    means = running(s.select("series_id", "t", "x", "x_fp"), {"_sum": F.col("x_fp")}, chunk)
    step = F.col("x") - F.col("_sum") / (F.col("t") + 1) / 100.0 - delta
    return _scored(_walk(means, step, chunk), F.col("run") - F.least(F.lit(0.0), F.col("low")), threshold)


def alert_gate(p: DataFrame, policy) -> DataFrame:
    """Rows (series_id, t, p_change) at which the gate emits, in order within each series."""

    def run(table: pa.Table) -> list[dict]:
        gate, name = Gate(policy), table.column("series_id")[0].as_py()
        rows = zip(table.column("t").to_pylist(), table.column("p_change").to_pylist(), strict=True)
        return [{"series_id": name, "t": t, "p_change": q} for t, q in rows if gate.emit(q, t)]

    return by_series(p.select("series_id", "t", "p_change"), "t", run, "series_id string, t bigint, p_change double")


def run_online(s: DataFrame, detector: str, order: str = "t", **options) -> DataFrame:
    """Every row's step, by the kernel that also serves the streams. With ts in nanoseconds (t_ns) late rows are handled."""
    columns = ["series_id", order, "x"] + (["t_ns"] if "t_ns" in s.columns else [])

    def run(table: pa.Table) -> list[dict]:
        model, name = make_online(detector, **options), table.column("series_id")[0].as_py()
        steps = model.update_many(table.column("x").to_pylist(), table.column("t_ns").to_pylist() if "t_ns" in columns else None)
        return [{"series_id": name, **vars(step)} for step in steps]

    return by_series(s.select(*columns), order, run, STEPS)


def late_counters(s: DataFrame) -> DataFrame:
    """Rows per series that come after a later time stamp, in arrival order."""
    before = F.max("t_ns").over(W.partitionBy("series_id").orderBy("arrival_seq").rowsBetween(W.unboundedPreceding, -1))
    return s.withColumn("_w", before).groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("t_ns") < F.col("_w")).alias("late"))


def watermark(s: DataFrame) -> DataFrame:
    """The greatest time stamp so far, in arrival order, without delay."""
    return s.withColumn("watermark", F.max("t_ns").over(W.partitionBy("series_id").orderBy("arrival_seq").rowsBetween(W.unboundedPreceding, 0)))


__all__ = ["ORDERED", "alert_gate", "cusum", "late_counters", "page_hinkley", "run_online", "watermark"]
