"""Entry points: detect on arrays or frames, a SQL table function, and the command line."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..config import Constraints, Stopping
from ..errors import BadJson, EngineError, InputOutput, InvalidInput
from ..functions.cost_kernels import matrix
from ..operators.diagnostics import diagnostics
from ..operators.offline_kernels import Outcome, detect
from ..operators.preprocess import preprocess as preprocess_frame
from ..sources import files
from .spec import PipelineSpec, execute


def detect_offline(values, pipeline=None, detector: str | None = None, cost: str | None = None, constraints=None, stopping=None, preprocess=None, repro_mode: str = "balanced", return_diagnostics: bool = False):
    """One series held as an array. pipeline excludes the other settings. Preprocessing and diagnostics run as plans.

    return_diagnostics: the outcome and the series' profile (None for one that is too short) instead of the outcome alone.
    """
    if pipeline is not None:
        if any(v is not None for v in (detector, cost, constraints, stopping, preprocess)):
            raise InvalidInput("pipeline excludes detector, cost, constraints, stopping and preprocess")
        spec = PipelineSpec.parse(pipeline)
    else:
        spec = PipelineSpec(detector or "pelt", cost or "l2", Constraints.of(constraints), Stopping.of(stopping), preprocess)
    x = matrix(values)
    if spec.preprocess or return_diagnostics:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        rows = files.from_rows(spark, np.asarray(values, dtype=np.float64))
    if spec.preprocess:
        cleaned = preprocess_frame(rows, spec.preprocess).orderBy("t").select("x").toPandas()["x"]
        x = matrix(np.array(cleaned.tolist(), dtype=float))
    outcome = detect(x, spec.detector, spec.cost, spec.stopping, spec.constraints, repro_mode, spec.options)
    return (outcome, diagnostics(rows.select("series_id", "t", "x")).first()) if return_diagnostics else outcome


def register_sql(spark: SparkSession) -> None:
    """detect_changes('detector', 'cost', TABLE(...) PARTITION BY series_id ORDER BY t): rows (series_id, change_point)."""
    from pyspark.sql.functions import udtf

    class DetectChanges:
        def __init__(self):
            self.rows, self.key, self.args = [], None, None

        def eval(self, detector: str, cost: str, row):
            self.key, self.args = row["series_id"], (detector, cost)
            self.rows.append(row["x"])

        def terminate(self):
            if self.rows:
                got = detect(matrix(np.array(self.rows, dtype=float)), *self.args, Stopping(), Constraints())
                for c in got.change_points:
                    yield self.key, int(c)

    spark.udtf.register("detect_changes", udtf(DetectChanges, returnType="series_id string, change_point bigint"))
    spark.udtf.register("changes_of", udtf(_changes_of()))


def _changes_of():
    """changes_of(TABLE(...), detector => ..., cost => ..., penalty => ... or k => ..., min_segment_len => ..., jump => ...,
    series => name, by => name, value => name): the series' column and change_point, one row for each.

    The columns are named, and the function itself asks for the rows of a series together and in order; without a series' column
    the table is one series. Settings and names must be constants; what does not fit is an error before anything runs.
    """
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
    from pyspark.sql.types import ArrayType, LongType, NumericType, StringType, StructField, StructType

    @dataclass
    class Settings(AnalyzeResult):
        detector: str = "pelt"
        cost: str = "l2"
        stopping: dict = field(default_factory=lambda: {"pen": "bic"})
        constraints: dict = field(default_factory=dict)
        series: str | None = None
        value: str = "x"

    class ChangesOf:
        def __init__(self, settings):
            self.settings, self.rows, self.key = settings, [], None

        @staticmethod
        def analyze(rows: AnalyzeArgument, **given: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise InvalidInput("the first argument must be a table")
            known = {"detector", "cost", "penalty", "k", "min_segment_len", "jump", "series", "by", "value"}
            unknown = sorted(set(given) - known)
            if unknown:
                raise InvalidInput(f"unknown argument {unknown[0]!r}")
            loose = sorted(name for name, a in given.items() if not a.isConstantExpression)
            if loose:
                raise InvalidInput(f"{loose[0]} must be a constant")
            g = {name: a.value for name, a in given.items()}
            columns = {f.name: f.dataType for f in rows.dataType.fields}
            series, by, value = g.get("series", "series_id" if "series_id" in columns else None), g.get("by", "t"), g.get("value", "x")
            for name in [c for c in (series, by, value) if c is not None]:
                if name not in columns:
                    raise InvalidInput(f"the table has no column {name!r}")
            kind = columns[value].elementType if isinstance(columns[value], ArrayType) else columns[value]
            if not isinstance(kind, NumericType):
                raise InvalidInput(f"{value} must be numeric, or an array of numbers")
            if "penalty" in g and "k" in g:
                raise InvalidInput("penalty and k exclude each other")
            stopping = {"k": int(g["k"])} if "k" in g else {"pen": g["penalty"] if isinstance(g.get("penalty"), str) else float(g["penalty"])} if "penalty" in g else {"pen": "bic"}
            constraints = {name: int(g[name]) for name in ("min_segment_len", "jump") if name in g}
            spec = PipelineSpec.parse({"detector": g.get("detector", "pelt"), "cost": g.get("cost", "l2"), "stopping": stopping, "constraints": constraints})  # refuses what it does not know
            out = StructType([StructField(series or "series_id", columns[series] if series else StringType()), StructField("change_point", LongType())])
            where = {"partitionBy": [PartitioningColumn(f"`{series}`")]} if series else {"withSinglePartition": True}
            return Settings(schema=out, orderBy=[OrderingColumn(f"`{by}`")], detector=spec.detector, cost=spec.cost, stopping=stopping, constraints=constraints, series=series, value=value, **where)

        def eval(self, rows, **given):
            self.key = rows[self.settings.series] if self.settings.series else "series"
            self.rows.append(rows[self.settings.value])

        def terminate(self):
            if self.rows:
                s = self.settings
                got = detect(matrix(np.array(self.rows, dtype=float)), s.detector, s.cost, Stopping.of(s.stopping), Constraints.of(s.constraints))
                for c in got.change_points:
                    yield self.key, int(c)

    return ChangesOf


def load(spark: SparkSession, path: str) -> DataFrame:
    return files.read_npy(spark, path) if path.endswith(".npy") else files.read_csv(spark, path)


def main(args: list[str] | None = None) -> int:
    """detect, run, doctor and eval; JSON on the standard output or in --output, an error with its code on the standard error."""
    parser = argparse.ArgumentParser(prog="driftline")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("detect", "run", "doctor", "eval"):
        p = sub.add_parser(name)
        p.add_argument("--input", required=name != "eval")
        p.add_argument("--output")
        if name == "detect":
            p.add_argument("--detector", default="pelt")
            p.add_argument("--cost", default="l2")
            p.add_argument("--penalty", type=float)
            p.add_argument("--k", type=int)
            p.add_argument("--min-segment-len", type=int, default=2)
            p.add_argument("--jump", type=int, default=1)
        if name == "run":
            p.add_argument("--pipeline", required=True)
        if name == "doctor":
            p.add_argument("--objective", default="balanced")
            p.add_argument("--online", action="store_true")
        if name == "eval":
            p.add_argument("--truth", required=True)
            p.add_argument("--predicted", required=True)
            p.add_argument("--n", type=int, required=True)
            p.add_argument("--tolerance", type=int, default=5)
    a = parser.parse_args(args)
    try:
        return _run(a)
    except EngineError as e:
        error = e
    except json.JSONDecodeError as e:
        error = BadJson(str(e))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        error = InputOutput(str(e))
    except OSError as e:
        error = InputOutput(str(e))
    print(json.dumps({"error": {"code": error.code, "message": str(error)}}), file=sys.stderr)
    return 2


def _run(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    spark = SparkSession.builder.getOrCreate()
    if a.command == "detect":
        stop = {"k": a.k} if a.k else {"pen": a.penalty if a.penalty else "bic"}
        out = execute(load(spark, a.input), {"detector": a.detector, "cost": a.cost, "stopping": stop, "constraints": {"min_segment_len": a.min_segment_len, "jump": a.jump}})
    elif a.command == "run":
        with open(a.pipeline) as source:
            out = execute(load(spark, a.input), source.read())
    elif a.command == "doctor":
        from .recommend import recommend

        s = load(spark, a.input).select("series_id", "t", "x")
        out = recommend(diagnostics(s), a.objective, a.online)
    else:
        from ..operators.evaluate import offline_metrics

        points = lambda text: spark.createDataFrame([("series", int(p)) for p in json.loads(text)], "series_id string, cp bigint")
        out = offline_metrics(points(a.truth), points(a.predicted), spark.createDataFrame([("series", a.n)], "series_id string, n bigint"), a.tolerance)
    body = "\n".join(r["value"] for r in out.select(F.to_json(F.struct(*out.columns)).alias("value")).toLocalIterator())
    if a.output:
        with open(a.output, "w") as target:
            target.write(body + "\n")
    else:
        print(body)
    return 0
