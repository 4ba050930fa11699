"""Pipeline specs: what to run, as plain data, and their execution, validation and consensus."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..config import Constraints, Penalty, Stopping
from ..errors import EngineError, InvalidInput, NotSupported
from ..functions.cost_kernels import COSTS, matrix
from ..functions.storage import written
from ..operators import detect as D
from ..operators import online as O
from ..operators.evaluate import tolerance_jaccard
from ..operators.grouped import by_series, numbers
from ..operators.offline_kernels import DETECTORS, detect
from ..operators.online_kernels import ONLINE
from ..operators.preprocess import preprocess

KEYS = {"detector", "cost", "constraints", "stopping", "preprocess", "seed", "options"}


@dataclass(frozen=True)
class PipelineSpec:
    detector: str = "pelt"
    cost: str = "l2"
    constraints: Constraints = field(default_factory=Constraints)
    stopping: Stopping = field(default_factory=Stopping)
    preprocess: dict | None = None
    seed: int | None = None
    options: dict = field(default_factory=dict)

    def to_json(self) -> str:
        body = asdict(self)
        body["stopping"] = {"k": self.stopping.k} if self.stopping.kind == "known_k" else {"path" if self.stopping.kind == "path" else "pen": [p.value or p.kind for p in self.stopping.penalties] if self.stopping.kind == "path" else self.stopping.penalties[0].value or self.stopping.penalties[0].kind}
        return json.dumps({"schema_version": 1, **body}, sort_keys=True)

    @staticmethod
    def parse(document) -> PipelineSpec:
        """From a dict or JSON: the detector is a name or {"kind": name, ...options}; unknown keys are refused."""
        body = json.loads(document) if isinstance(document, str) else dict(document)
        version = body.pop("schema_version", 1)
        if version not in (0, 1, 2):
            raise InvalidInput(f"spec version {version} is not supported")
        body = body.pop("payload", body)
        if "kind" in body and "detector" not in body:
            body = {"detector": body}
        unknown = set(body) - KEYS
        if unknown:
            raise InvalidInput(f"unknown key {sorted(unknown)[0]!r} in the pipeline spec")
        detector, options = body.get("detector", "pelt"), dict(body.get("options") or {})
        if isinstance(detector, dict):
            options |= {k: v for k, v in detector.items() if k != "kind"}
            detector = detector["kind"]
        detector = {"segneigh": "dynp", "bottomup": "bottom_up"}.get(detector, detector)
        cost = {"l1_median": "l1", "l2_mean": "l2", "normal_mean_var": "normal"}.get(body.get("cost", "l2"), body.get("cost", "l2"))
        if detector not in DETECTORS and detector not in ONLINE and detector not in ("kernel", "gp", "argp"):
            raise NotSupported(f"unknown detector {detector!r}")
        if detector in DETECTORS and cost not in COSTS and cost is not None:
            raise NotSupported(f"unknown cost {cost!r}")
        if body.get("seed") is not None:
            options.setdefault("seed", body["seed"]) if detector == "wbs" else None
        return PipelineSpec(detector, cost or "l2", Constraints.of(body.get("constraints")), Stopping.of(body.get("stopping")), body.get("preprocess"), body.get("seed"), options)

    @staticmethod
    def of_recommendation(pipeline: str) -> PipelineSpec:
        """The spec that the name of a recommended pipeline stands for."""
        kind, detector, *rest = pipeline.split(":")
        settings = dict(r.split("=") for r in rest if "=" in r)
        model = next((r for r in rest if "=" not in r), None)
        if kind == "online":
            options = {"model": model} if model else {}
            return PipelineSpec(detector, "l2", options=options | ({"max_run_length": int(settings["max_run_length"])} if "max_run_length" in settings else {}))
        # Intervals in strata against masking; at random where a dense series stands in for another detector.
        options = {"strategy": "random" if model == "l2" else "stratified"} if detector == "wbs" else {}
        return PipelineSpec(detector, {"l1_median": "l1"}.get(model, model), Constraints(jump=int(settings.get("jump", 1))), Stopping.of({"pen": "bic"}) if detector == "dynp" else Stopping(), options=options)


def execute(s: DataFrame, spec: PipelineSpec | dict, repro_mode: str = "balanced", errors: str = "raise") -> DataFrame:
    """Preprocess and run a spec over all series of s: results for offline detectors, steps for online ones."""
    spec = PipelineSpec.parse(spec) if isinstance(spec, (dict, str)) else spec
    s = preprocess(s, spec.preprocess)
    if spec.detector in ONLINE:
        return O.run_online(s, spec.detector, **spec.options)
    return D.detect_series(s, spec.detector, spec.cost, spec.stopping, spec.constraints, repro_mode, spec.options, errors=errors)


def run_specs(s: DataFrame, specs: list[PipelineSpec], scales: tuple = (1.0,)) -> DataFrame:
    """series_id, voter (place of the spec), scale, n, change_points (null where a detector refused the series) and note, of all
    specs over all series. Specs that preprocess alike share one pass: the series are dealt out once for all of them.

    scale: of the penalty; a spec without a penalty runs at 1 only.
    """
    alike: dict[str, list[tuple[int, PipelineSpec]]] = {}
    for i, spec in enumerate(specs):
        alike.setdefault(json.dumps(spec.preprocess, sort_keys=True), []).append((i, spec))
    every = None
    for group in alike.values():

        def run(table: pa.Table, group=group) -> list[dict]:
            name, out = table.column("series_id")[0].as_py(), []
            for i, spec in group:
                for scale in scales:
                    row = {"series_id": name, "voter": i, "scale": scale, "n": table.num_rows, "change_points": None, "note": None}
                    try:
                        x = matrix(numbers(table.column("x")))
                        one = scaled(spec, scale, x)
                        if one is None:
                            continue
                        row["change_points"] = detect(x, one.detector, one.cost, one.stopping, one.constraints, options=one.options).change_points
                    except EngineError as e:
                        row["note"] = f"{e.code}: {e}"
                    out.append(row)
            return out

        rows = by_series(preprocess(s.select("series_id", "t", "x"), group[0][1].preprocess), "t", run, _RUNS)
        every = rows if every is None else every.unionByName(rows)
    return every


_RUNS = "series_id string, voter int, scale double, n bigint, change_points array<bigint>, note string"


def scaled(spec: PipelineSpec, scale: float, x: np.ndarray) -> PipelineSpec | None:
    """The spec with its penalties, as they are for x, times scale; None if it stops by the number of changes."""
    if scale == 1.0:
        return spec
    if spec.stopping.kind == "known_k":
        return None
    params = COSTS[spec.cost](x).effective if spec.detector in DETECTORS else 2
    penalties = tuple(Penalty("manual", p.beta(len(x), params) * scale) for p in spec.stopping.penalties)
    return replace(spec, stopping=replace(spec.stopping, penalties=penalties))


def cluster(found: list[list[int]], tolerance: int, moving: bool = True) -> list[tuple[int, int]]:
    """(place, votes) of groups of change points, from the points of one pipeline after another, each in order.

    A point joins the group whose anchor is nearest, within the tolerance; the older one of two as near. A pipeline has one point
    in a group, the one nearest to the anchor. moving: the anchor is the upper median of these points; else it stays.
    """
    groups: list[dict] = []
    for voter, points in enumerate(found):
        for place in points:
            near = [(abs(place - g["anchor"]), i) for i, g in enumerate(groups) if abs(place - g["anchor"]) <= tolerance]
            if not near:
                groups.append({"anchor": place, "own": {voter: place}})
                continue
            g = groups[min(near)[1]]
            g["own"][voter] = min(g["own"].get(voter, place), place, key=lambda p: (abs(p - g["anchor"]), p))
            if moving:
                g["anchor"] = sorted(g["own"].values())[len(g["own"]) // 2]
    return sorted((g["anchor"], len(g["own"])) for g in groups)


def _offline(specs: list, what: str) -> list[PipelineSpec]:
    specs = [PipelineSpec.parse(x) if isinstance(x, (dict, str)) else x for x in specs]
    own = [x for x in specs if x.detector not in ONLINE]  # online pipelines give no segmentation and are passed over
    if not own:
        raise InvalidInput(f"{what} needs offline pipelines")
    return own


def _support(runs: DataFrame, tolerance: int, moving: bool) -> DataFrame:
    """series_id, change_point, votes and attempted of each group of a series' change points."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("voter")
        found = cluster([c or [] for c in rows.column("change_points").to_pylist()], tolerance, moving)
        name = [rows.column("series_id")[0].as_py()] * len(found)
        return pa.table([pa.array(name, pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64()), pa.array([rows.num_rows] * len(found), pa.int64())], names=["series_id", "change_point", "votes", "attempted"])

    return runs.select("series_id", "voter", "change_points").groupBy("series_id").applyInArrow(run, "series_id string, change_point bigint, votes bigint, attempted bigint")


def ensemble(s: DataFrame, specs: list, tolerance: int = 3, min_ratio: float = 0.5) -> DataFrame:
    """Consensus change points: series_id, change_point, votes, attempted. A point needs the votes of min_ratio of all pipelines
    that were tried on the series, those that failed included."""
    if not 0 <= min_ratio <= 1:
        raise InvalidInput(f"the ratio must be from 0 to 1; got {min_ratio}")
    runs = run_specs(s, _offline(specs, "an ensemble"))
    return _support(runs, tolerance, True).where(F.col("votes") / F.col("attempted") + 1e-12 >= min_ratio)


def thinned(s: DataFrame, stride: int) -> DataFrame:
    """Every stride-th row and the last one, renumbered, with the place in s as _row; series of up to two rows stay whole."""
    n = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    step = F.when(F.col("_n") > 2, F.lit(stride)).otherwise(F.lit(1))
    cut = s.join(n, "series_id").withColumn("_step", step).where((F.col("t") % F.col("_step") == 0) | (F.col("t") == F.col("_n") - 1))
    at = F.expr("t div _step") + F.when(F.col("t") % F.col("_step") == 0, 0).otherwise(1)
    return cut.select("series_id", at.alias("t"), "x", F.col("t").alias("_row"))


def validate(s: DataFrame, specs: list, tolerance: int | None = None, stride: int | None = None) -> DataFrame:
    """Per series: stability (mean pairwise agreement of the pipelines), agreement (mean support of their clusters), penalty
    sensitivity (how far each departs from itself at 0.9 and 1.1 times its penalty; null without penalties), how many pipelines
    ran, and notes on those that did not.

    stride: validate on every stride-th row; change points are told in places of the whole series. The tolerance is the stride
    unless given, and at least 1. Missing values are filled with the value before, at the start with 0. A series on which no
    pipeline ran, or only one of several, has no scores.
    """
    specs = _offline(specs, "validation")
    stride = 1 if stride is None else stride
    if stride < 1:
        raise InvalidInput("the stride must be at least 1")
    tolerance = max(stride, 1) if tolerance is None else tolerance
    rows = thinned(s.select("series_id", "t", "x"), stride)
    several = isinstance(s.schema["x"].dataType, ArrayType)
    order = W.partitionBy("series_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.coalesce(F.last(F.when(~(c.isNull() | F.isnan(c)), c), ignorenulls=True).over(order), F.lit(0.0))
    if several:
        size = s.select(F.max(F.size("x"))).first()[0] or 0
        rows = rows.withColumn("x", F.array(*[last(F.get("x", F.lit(i)).cast("double")) for i in range(size)]))
    else:
        rows = rows.withColumn("x", last(F.col("x").cast("double")))
    places = rows.groupBy("series_id").agg(F.max("_row").alias("_last"))
    runs = run_specs(rows, specs, (1.0, 0.9, 1.1)).join(places, "series_id")
    runs = runs.withColumn("change_points", F.transform("change_points", lambda c: F.least(c * stride, F.col("_last"))))
    runs = written(runs.select("series_id", "voter", "scale", "change_points", "note"), "validation")
    base = runs.where("scale = 1.0")
    by = base.groupBy("series_id").agg(F.count("change_points").alias("ran"), F.count(F.lit(1)).alias("tried"), F.array_sort(F.collect_list("note")).alias("notes"))
    own = base.where("change_points is not null").select("series_id", "voter", F.col("change_points").alias("a"))
    other = own.select("series_id", F.col("voter").alias("_other"), F.col("a").alias("b"))
    pairs = own.join(other, "series_id").where(F.col("voter") < F.col("_other"))
    stable = pairs.groupBy("series_id").agg(F.avg(tolerance_jaccard("a", "b", tolerance)).alias("stability"))
    agreed = _support(base.where("change_points is not null"), tolerance, False).groupBy("series_id").agg(F.avg(F.col("votes") / F.col("attempted")).alias("agreement"))
    moved = runs.where("scale != 1.0 and change_points is not null").select("series_id", "voter", F.col("change_points").alias("b"))
    each = own.join(moved, ["series_id", "voter"]).groupBy("series_id", "voter").agg(F.avg(tolerance_jaccard("a", "b", tolerance)).alias("same"), F.count(F.lit(1)).alias("k")).where("k = 2")
    moves = each.groupBy("series_id").agg(F.avg(1 - F.col("same")).alias("penalty_sensitivity"))
    out = by.join(stable, "series_id", "left").join(agreed, "series_id", "left").join(moves, "series_id", "left")
    enough = (F.col("ran") >= F.least(F.col("tried"), F.lit(2))) & (F.col("ran") > 0)
    score = lambda c, none: F.when(enough, F.coalesce(c, F.lit(none)))
    return out.select("series_id", score("stability", 1.0).alias("stability"), score("agreement", 1.0).alias("agreement"), F.when(enough, F.col("penalty_sensitivity")).alias("penalty_sensitivity"), "ran", "notes")
