"""Offline detection over many series at once, and the familiar front ends for one series."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import REPRO_MODES, Constraints, Stopping
from ..errors import EngineError, InvalidInput, NotSupported
from ..functions.cost_kernels import COSTS, matrix
from ..functions.native import missing
from .grouped import by_series, numbers
from .offline_kernels import DETECTORS, SELF_COSTED, Outcome, detect
from .short_series import detect_many

SCHEMA_VERSION = 1
#: Rows of series that a task takes together; a series with more is taken alone.
TOGETHER = 20_000
RESULT = (
    "series_id string, n bigint, breakpoints array<bigint>, change_points array<bigint>, objective double, "
    "diagnostics struct<schema_version:int,algorithm:string,cost_model:string,repro_mode:string,notes:array<string>,warnings:array<string>,params_json:string>"
)


def detect_series(s: DataFrame, detector: str = "pelt", cost: str = "l2", stopping=None, constraints=None, repro_mode: str = "balanced", options: dict | None = None, cost_options: dict | None = None, errors: str = "raise") -> DataFrame:
    """One result row per series of s (series_id, t, x or array x). One series is one task's work; series run in parallel.

    errors: raise stops at the first series that a detector refuses; row gives such a series no breakpoints and the reason
    among its warnings, so that it cannot fail the others.
    """
    stopping, constraints = Stopping.of(stopping), Constraints.of(constraints)
    if repro_mode not in REPRO_MODES:
        raise InvalidInput(f"unknown repro mode {repro_mode!r}")
    if detector not in DETECTORS and detector not in SELF_COSTED:
        raise NotSupported(f"unknown detector {detector!r}")
    if detector in DETECTORS and cost not in COSTS:
        raise NotSupported(f"unknown cost {cost!r}")
    params = json.dumps({"stopping": stopping.kind, "constraints": {k: v for k, v in constraints.to_dict().items() if v is not None}}, sort_keys=True)

    def read(table: pa.Table) -> np.ndarray | EngineError:
        try:
            return matrix(numbers(table.column("x")))
        except EngineError as e:
            return e

    def run(tables: list[pa.Table]) -> list[dict]:
        xs = [read(table) for table in tables]
        some = iter(detect_many([x for x in xs if isinstance(x, np.ndarray)], detector, cost, stopping, constraints, repro_mode, options, cost_options))
        out = []
        for table, x in zip(tables, xs, strict=True):
            got = next(some) if isinstance(x, np.ndarray) else x
            if isinstance(got, EngineError):
                if errors == "raise":
                    raise got
                got = Outcome([], None, [], [f"{got.code}: {got}"])
            diagnostics = {"schema_version": SCHEMA_VERSION, "algorithm": detector, "cost_model": cost, "repro_mode": repro_mode, "notes": got.notes, "warnings": got.warnings, "params_json": params}
            out.append({"series_id": table.column("series_id")[0].as_py(), "n": table.num_rows, "breakpoints": got.breakpoints, "change_points": got.change_points, "objective": got.objective, "diagnostics": diagnostics})
        return out

    return by_series(s.select("series_id", "t", "x"), "t", run, RESULT, together=TOGETHER)


def change_points(results: DataFrame) -> DataFrame:
    """One row per change point, numbered from 0."""
    return results.select("series_id", "n", F.posexplode("change_points").alias("idx", "change_point"))


def segments(results: DataFrame) -> DataFrame:
    """One row per segment: series_id, seg_idx, start, end."""
    ends = results.select("series_id", F.posexplode("breakpoints").alias("seg_idx", "end"))
    start = F.coalesce(F.lag("end").over(W.partitionBy("series_id").orderBy("seg_idx")), F.lit(0).cast("long"))
    return ends.select("series_id", "seg_idx", start.alias("start"), "end")


def segment_stats(s: DataFrame, results: DataFrame) -> DataFrame:
    """Mean, variance, count and missing count of each segment: the start of a row's segment is found by a running join-free
    look at the segments' starts, so a long series needs no range join."""
    marks = segments(results).select("series_id", F.col("start").alias("t"), F.lit(None).cast("double").alias("x"), F.col("seg_idx"), F.lit(0).alias("_o"))
    rows = s.select("series_id", "t", "x", F.lit(None).cast("int").alias("seg_idx"), F.lit(1).alias("_o"))
    order = W.partitionBy("series_id").orderBy("t", "_o").rowsBetween(W.unboundedPreceding, 0)
    cut = marks.unionByName(rows).withColumn("seg_idx", F.last("seg_idx", ignorenulls=True).over(order)).where("_o = 1")
    valid = F.when(~missing(), F.col("x"))
    return cut.groupBy("series_id", "seg_idx").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"), F.avg(valid).alias("mean"), F.var_pop(valid).alias("variance"), F.count(F.lit(1)).alias("count"), F.count_if(missing()).alias("missing_count"))


class _Front:
    """fit(x) keeps a series; predict(pen=) or predict(n_bkps=) segments it."""

    detector, costs = "pelt", tuple(COSTS)

    def __init__(self, model: str = "l2", min_size: int = 2, jump: int = 1, **options):
        self.cost, self.constraints, self.options = model, Constraints(min_segment_len=min_size, jump=jump), options
        self.x = None

    def fit(self, x):
        self.x = matrix(x)
        return self

    def predict(self, pen: float | None = None, n_bkps: int | None = None) -> Outcome:
        if self.x is None:
            raise InvalidInput("fit must come before predict")
        if (pen is None) == (n_bkps is None):
            raise InvalidInput("exactly one of pen and n_bkps must be given")
        stopping = Stopping.penalized(pen) if n_bkps is None else Stopping.known(n_bkps)
        return detect(self.x, self.detector, self.cost, stopping, self.constraints, options=self.options)


class Pelt(_Front):
    detector = "pelt"


class Binseg(_Front):
    detector = "binseg"


class Fpop(_Front):
    detector = "fpop"


def plot(result: Outcome, x, ax=None):
    """Lines at the change points; needs matplotlib."""
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise NotSupported("plotting needs matplotlib") from e
    ax = ax or plt.subplots()[1]
    ax.plot(np.asarray(x))
    for c in result.change_points:
        ax.axvline(c, linestyle="--")
    return ax
