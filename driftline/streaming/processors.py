"""Online detectors as Structured Streaming operators: one stateful processor per detector, the same steps as in batch.

State is the detector's own, per series, in the query's state store; a restarted query goes on where it stopped. Within a
micro-batch rows are taken in the order of an explicit arrival column, since a batch has none of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..errors import EngineError
from ..operators.online_kernels import make_online

#: What happens to late rows, counted; each row of the output has what it added.
COUNTERS = ("late", "buffered", "reordered", "dropped_oldest", "dropped_newest", "overflow_errors")
#: The latency of a row is null: rows are taken in batches, whose times the query's progress tells.
OUTPUT = "series_id string, t bigint, p_change double, alert boolean, alert_reason string, run_length_mode bigint, run_length_mean double, status string, " + ", ".join(f"{c} int" for c in COUNTERS) + ", processing_latency_us bigint"
#: Output rows that a task holds at a time.
ROWS = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DetectorProcessor(StatefulProcessor):
    """Feeds a detector by series. strict: a refused row stops the query; else it gives a row with its reason as status."""

    def __init__(self, detector: str, options: dict, order: str, strict: bool):
        self.detector, self.options, self.order, self.strict = detector, options, order, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("detector", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        model = make_online(self.detector, **self.options)
        if self.state.exists():
            model.load_state(json.loads(self.state.get()[0]))
        pdf = pd.concat([frame[[c for c in (self.order, "x", "t_ns") if c in frame]] for frame in rows], ignore_index=True).sort_values(self.order, kind="stable")
        held = None
        for start in range(0, len(pdf), ROWS):
            if held is not None:
                yield held
            held = self._steps(model, key[0], pdf.iloc[start : start + ROWS])
        self.state.update((json.dumps(model.save_state()),))
        if held is not None:
            yield held

    def _steps(self, model, name: str, pdf: pd.DataFrame) -> pd.DataFrame:
        """The output rows of some rows; of all rows of a long series at once they would take gigabytes."""
        out = []
        times = pdf["t_ns"].tolist() if "t_ns" in pdf else [None] * len(pdf)
        for x, ts in zip(pdf["x"].tolist(), times, strict=True):
            before = dict(model.counters)
            try:
                step = vars(model.update(x, None if ts is None else int(ts))) | {"status": "ok"}
            except EngineError as e:
                if self.strict:
                    raise
                step = {"t": max(model.t - 1, 0), "p_change": None, "alert": False, "alert_reason": None, "run_length_mode": None, "run_length_mean": None, "status": f"{e.code}: {e}"}
            out.append({"series_id": name, **step, **{c: model.counters[c] - before[c] for c in COUNTERS}, "processing_latency_us": None})
        frame = pd.DataFrame(out)
        for c in ("run_length_mode", "processing_latency_us"):
            frame[c] = frame[c].astype("Int64")
        return frame

    def close(self) -> None:
        pass


def detect_stream(stream: DataFrame, detector: str, order: str = "arrival_seq", strict: bool = False, **options) -> DataFrame:
    """The steps of a streaming frame (series_id, x, the order column and, for late rows, t_ns) in append mode.

    Needs the RocksDB state store provider (see ROCKSDB).
    """
    columns = list(dict.fromkeys(["series_id", order, "x"] + (["t_ns"] if "t_ns" in stream.columns else [])))
    return stream.select(*columns).groupBy("series_id").transformWithStateInPandas(DetectorProcessor(detector, options, order, strict), OUTPUT, "Append", "None")


def windowed_alerts(steps: DataFrame, every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Alerts per series and event-time window of a frame with ts (timestamp), with Spark's own watermark."""
    return steps.withWatermark("ts", late).groupBy("series_id", F.window("ts", every)).agg(F.count_if("alert").alias("alerts"), F.max("p_change").alias("top"))


def observed(steps: DataFrame, name: str = "late_rows") -> DataFrame:
    """The steps, with the six counters of each batch as metrics of the query's progress."""
    return steps.observe(name, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


@dataclass
class Run:
    """What the progress of a finished query tells: rows, the six counters, and the milliseconds of its batches."""

    rows: int
    counters: dict
    batch_ms: list[int]

    @property
    def us_per_row(self) -> float | None:
        return 1000 * sum(self.batch_ms) / self.rows if self.rows else None


def run_available(stream: DataFrame, checkpoint: str, sink: str, name: str = "late_rows") -> Run:
    """Process what is there and stop; sink is a Parquet folder. The session's own state store is put back afterwards.

    The figures are read from the query's progress, batch by batch; the session keeps as many batches as
    spark.sql.streaming.numRecentProgressUpdates says, so that it is raised for the run.
    """
    conf = stream.sparkSession.conf
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.numRecentProgressUpdates": "100000"}
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        steps = observed(stream, name) if set(COUNTERS) <= set(stream.columns) else stream
        query = steps.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        rows, counters, ms = 0, dict.fromkeys(COUNTERS, 0), []
        for progress in query.recentProgress:
            seen = progress.observedMetrics.get(name)
            if seen is not None:
                rows += seen["rows"]
                counters = {c: counters[c] + seen[c] for c in COUNTERS}
                ms.append(progress.durationMs["triggerExecution"])
        return Run(rows, counters, ms)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
