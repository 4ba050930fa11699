"""Constraints, stopping rules, penalties and late-data policies. Validated on the driver, shipped into tasks."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace

from .errors import InvalidInput

REPRO_MODES = ("strict", "balanced", "fast")


@dataclass(frozen=True)
class Penalty:
    """kind: bic, aic or manual; value belongs to manual."""

    kind: str = "bic"
    value: float | None = None

    def __post_init__(self):
        if self.kind not in ("bic", "aic", "manual"):
            raise InvalidInput(f"unknown penalty kind {self.kind!r}")
        if self.kind == "manual" and not (self.value is not None and math.isfinite(self.value) and self.value > 0):
            raise InvalidInput(f"a manual penalty must be finite and > 0; got {self.value}")

    def beta(self, n: int, params: int) -> float:
        return {"bic": lambda: params * math.log(n), "aic": lambda: 2.0 * params, "manual": lambda: float(self.value)}[self.kind]()

    @staticmethod
    def of(value) -> Penalty:
        if isinstance(value, Penalty):
            return value
        if isinstance(value, str):
            return Penalty(value.lower())
        if isinstance(value, dict):
            return Penalty(value.get("kind", "manual"), value.get("value"))
        return Penalty("manual", float(value))


@dataclass(frozen=True)
class Stopping:
    """known_k (k >= 1), penalized (one penalty) or path (several; results are those of the first)."""

    kind: str = "penalized"
    k: int | None = None
    penalties: tuple[Penalty, ...] = (Penalty(),)

    def __post_init__(self):
        if self.kind == "known_k":
            if not self.k or self.k < 1:
                raise InvalidInput(f"known_k requires k >= 1; got {self.k}")
        elif self.kind in ("penalized", "path"):
            if not self.penalties or self.kind == "penalized" and len(self.penalties) != 1:
                raise InvalidInput(f"{self.kind} has the wrong number of penalties")
        else:
            raise InvalidInput(f"unknown stopping rule {self.kind!r}")

    @staticmethod
    def known(k: int) -> Stopping:
        return Stopping("known_k", k, ())

    @staticmethod
    def penalized(penalty="bic") -> Stopping:
        return Stopping("penalized", None, (Penalty.of(penalty),))

    @staticmethod
    def path(penalties) -> Stopping:
        return Stopping("path", None, tuple(map(Penalty.of, penalties)))

    @staticmethod
    def of(value) -> Stopping:
        if isinstance(value, Stopping):
            return value
        if value is None:
            return Stopping()
        if "n_bkps" in value:
            return Stopping.known(int(value["n_bkps"]))
        if "k" in value:
            return Stopping.known(int(value["k"]))
        if "path" in value:
            return Stopping.path(value["path"])
        return Stopping.penalized(value.get("pen", value.get("penalty", "bic")))


@dataclass(frozen=True)
class Constraints:
    min_segment_len: int = 2
    jump: int = 1
    max_change_points: int | None = None
    max_depth: int | None = None
    candidate_splits: tuple[int, ...] | None = None
    time_budget_ms: int | None = None
    max_cost_evals: int | None = None
    memory_budget_bytes: int | None = None
    max_cache_bytes: int | None = None
    cache_policy: str = "full"
    degradation_plan: tuple[str, ...] = ()
    allow_algorithm_fallback: bool = False

    def __post_init__(self):
        for name in ("min_segment_len", "jump"):
            if getattr(self, name) < 1:
                raise InvalidInput(f"{name} must be >= 1; got {getattr(self, name)}")
        for name in ("max_depth", "time_budget_ms", "max_cost_evals", "memory_budget_bytes", "max_cache_bytes"):
            value = getattr(self, name)
            if value is not None and value < 1:
                raise InvalidInput(f"{name} must be >= 1 when given; got {value}")
        if self.cache_policy not in ("full", "budgeted", "approximate"):
            raise InvalidInput(f"unknown cache policy {self.cache_policy!r}")

    def candidates(self, n: int) -> list[int]:
        """Split positions that jump and the least segment length allow, in order."""
        if n < 1:
            raise InvalidInput("a series needs at least one row")
        if self.candidate_splits is None:
            return [s for s in range(self.jump, n, self.jump) if s >= self.min_segment_len and n - s >= self.min_segment_len]
        splits = list(self.candidate_splits)
        if any(s <= 0 or s >= n for s in splits):
            raise InvalidInput("candidate_splits must lie strictly inside the series")
        if splits != sorted(set(splits)):
            raise InvalidInput("candidate_splits must be strictly increasing")
        return [s for s in splits if s % self.jump == 0 and s >= self.min_segment_len and n - s >= self.min_segment_len]

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def of(value) -> Constraints:
        if value is None:
            return Constraints()
        if isinstance(value, Constraints):
            return value
        unknown = set(value) - set(Constraints.__dataclass_fields__)
        if unknown:
            raise InvalidInput(f"unknown constraint {sorted(unknown)[0]!r}")
        value = dict(value)
        for name in ("candidate_splits", "degradation_plan"):
            if value.get(name) is not None:
                value[name] = tuple(value[name])
        return replace(Constraints(), **value)


@dataclass(frozen=True)
class AlertPolicy:
    """Emit when armed, past the cooldown, with p >= threshold and enough rows; re-arm when p < threshold - hysteresis."""

    threshold: float = 0.5
    cooldown: int = 0
    hysteresis: float = 0.05
    min_run_length: int = 1

    def __post_init__(self):
        if not (math.isfinite(self.threshold) and 0 <= self.threshold <= 1):
            raise InvalidInput(f"alert threshold must lie in [0, 1]; got {self.threshold}")
        if not (math.isfinite(self.hysteresis) and 0 <= self.hysteresis <= self.threshold):
            raise InvalidInput(f"hysteresis must lie in [0, threshold]; got {self.hysteresis}")
        if self.cooldown < 0 or self.min_run_length < 1:
            raise InvalidInput("cooldown must be >= 0 and min_run_length >= 1")


@dataclass(frozen=True)
class LatePolicy:
    """kind: reject, buffer (in arrival order) or reorder (by time, then arrival); overflow: drop_oldest, drop_newest, error."""

    kind: str = "reject"
    max_delay_ns: int = 0
    max_items: int = 1
    overflow: str = "error"

    def __post_init__(self):
        if self.kind not in ("reject", "buffer", "reorder"):
            raise InvalidInput(f"unknown late-data policy {self.kind!r}")
        if self.overflow not in ("drop_oldest", "drop_newest", "error"):
            raise InvalidInput(f"unknown overflow policy {self.overflow!r}")
        if self.kind != "reject" and (self.max_delay_ns <= 0 or self.max_items <= 0):
            raise InvalidInput("buffering needs max_delay_ns > 0 and max_items > 0")


@dataclass
class Budget:
    """Counts cost evaluations of a kernel and stops it at its limits."""

    max_evals: int | None = None
    time_ms: int | None = None
    soft: bool = False
    evals: int = 0
    started: float = 0.0
    warnings: list[str] = field(default_factory=list)

    def spend(self, k: int = 1) -> None:
        import time

        from .errors import ResourceLimit

        self.evals += k
        self.started = self.started or time.monotonic()
        over = None
        if self.max_evals is not None and self.evals > self.max_evals:
            over = f"cost evaluations exceeded {self.max_evals}"
        elif self.time_ms is not None and (time.monotonic() - self.started) * 1000 > self.time_ms:
            over = f"time budget of {self.time_ms} ms exceeded"
        if over and not self.soft:
            raise ResourceLimit(over)
        if over and over not in self.warnings:
            self.warnings.append(over)
