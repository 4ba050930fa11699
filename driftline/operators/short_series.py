"""Optimal partitioning of many short series at once, in arrays over all of them.

One series of some dozens of rows takes far more time in calls of numpy than in arithmetic. Here the series of a group take each step
of the recursion together, and the costs of all segments of one length (or that stop at one row) are computed together. No start is
pruned. Results are those of `offline_kernels` for each series by itself: the same operations in the same order, ties to the smaller
start. The sums of products of `ar` are added in another order, so that its costs differ in their last digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from ..config import Constraints, Stopping
from ..errors import EngineError, InvalidInput
from ..functions.cost_kernels import VAR_FLOOR, make_cost
from .offline_kernels import Outcome, detect

#: The longest series that is taken together with others.
LONGEST = 512
#: Squares of lengths that a group may add up to: it holds some arrays of as many doubles.
SQUARES = 1 << 19
#: Detectors and costs that take series together, with the options that the costs may have; ar from order 2.
OPTIONS = {("pelt", "l2"): {"scale"}, ("fpop", "l2"): {"scale"}, ("pelt", "l1"): set(), ("pelt", "ar"): {"p"}}


class Group:
    """Series of one column side by side, padded by zeros to the longest one."""

    def __init__(self, xs: list[np.ndarray]):
        self.n = np.array([len(x) for x in xs])
        self.size, self.longest = len(xs), int(self.n.max())
        self.x = np.zeros((self.size, self.longest))
        for row, x in zip(self.x, xs, strict=True):
            row[: len(x)] = x

    def l2(self, least: int, scale: float = 1.0) -> Iterator[tuple[int, np.ndarray]]:
        """For each end t the costs of the segments that stop there, by series and start (0 .. t - 1); those shorter than least
        are not used."""
        s1, s2 = np.zeros((2, self.size, self.longest + 1))
        np.cumsum(self.x, axis=1, out=s1[:, 1:])
        np.cumsum(self.x * self.x, axis=1, out=s2[:, 1:])
        for t in range(1, self.longest + 1):
            m = np.arange(t, 0, -1, dtype=np.float64)
            a, b = s1[:, t : t + 1] - s1[:, :t], s2[:, t : t + 1] - s2[:, :t]
            cost = np.maximum(b - a * a / m, 0.0)
            yield t, cost / (scale * scale) if scale != 1 else cost


    def _windows(self, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length the series and starts of its segments, and their values as rows."""
        series, start = np.nonzero(np.arange(self.longest) < self.n[:, None])
        flat, first = self.x.ravel(), series * self.longest + start
        for m in range(least, self.longest + 1):
            fits = start + m <= self.n[series]
            series, start, first = series[fits], start[fits], first[fits]
            step = max(1, SQUARES // m)
            for i in range(0, len(first), step):
                yield m, series[i : i + step], start[i : i + step], flat[first[i : i + step, None] + np.arange(m)]

    def _by_length(self, least: int, cost: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """As l2, of a cost that takes segments of one length at a time; shorter ones than least are not used and cost nothing."""
        costs = np.zeros((self.longest, self.size, self.longest))
        for m, series, start, values in self._windows(least):
            costs[start + m - 1, series, start] = cost(values)
        for t in range(1, self.longest + 1):
            yield t, costs[t - 1, :, :t]

    def l1(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        def cost(values: np.ndarray) -> np.ndarray:
            half = values.shape[1] // 2
            ranked = np.partition(values, [max(half - 1, 0), half], axis=1)
            middle = ranked[:, half] if values.shape[1] % 2 else (ranked[:, half - 1] + ranked[:, half]) / 2
            return np.abs(values - middle[:, None]).sum(axis=1)

        return self._by_length(least, cost)


    def ar(self, least: int, p: int) -> Iterator[tuple[int, np.ndarray]]:
        """By Yule-Walker equations, for orders above 1."""
        floor = math.log(VAR_FLOOR)

        def cost(values: np.ndarray) -> np.ndarray:
            count, m = values.shape
            if m <= p + 1:
                return np.zeros(count)
            y = values - values.mean(axis=1)[:, None]
            cov = np.array([np.einsum("ij,ij->i", y[:, k:], y[:, : m - k]) / m for k in range(p + 1)])
            phi, noise = np.zeros((p, count)), cov[0].copy()
            on = np.ones(count, dtype=bool)
            for k in range(p):
                on &= noise > VAR_FLOOR
                r = np.where(on, cov[k + 1] - (phi[:k] * cov[k:0:-1]).sum(axis=0), 0.0) / np.where(on, noise, 1.0)
                phi[:k] -= r * phi[:k][::-1].copy()
                phi[k] = r
                noise *= 1 - r * r
            resid = y[:, p:].copy()
            for k in range(p):
                resid -= phi[k][:, None] * y[:, p - 1 - k : m - 1 - k]
            var = np.einsum("ij,ij->i", resid, resid) / (m - p)
            return (m - p) * np.where(var > VAR_FLOOR, np.log(np.maximum(var, VAR_FLOOR)), floor)

        return self._by_length(least, cost)


def _step(best: np.ndarray, back: np.ndarray, t: int, cost: np.ndarray, beta: np.ndarray, n: np.ndarray, m: int) -> None:
    """The best objective of all prefixes that end at t, and the start of their last segment."""
    value = best[:, : t - m + 1] + cost[:, : t - m + 1] + beta[:, None]
    at = np.argmin(value, axis=1)
    top = value[np.arange(len(n)), at]
    fits = ((t == n) | (n - t >= m)) & (top < np.inf)
    best[:, t], back[:, t] = np.where(fits, top, np.inf), np.where(fits, at, 0)


def _partitions(costs, beta: np.ndarray, n: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Optimal partitioning of each series by its own penalty: objectives of all prefixes, and starts of their last segments."""
    best, back = np.full((len(n), int(n.max()) + 1), np.inf), np.zeros((len(n), int(n.max()) + 1), dtype=np.int64)
    best[:, 0] = -beta
    for t, cost in costs:
        if t >= m:
            _step(best, back, t, cost, beta, n, m)
    return best, back


def _path(back: np.ndarray, n: int) -> list[int]:
    out = [n]
    while back[out[-1]] > 0:
        out.append(int(back[out[-1]]))
    return out[::-1]


def _least(costs: list[tuple[int, np.ndarray]], n: np.ndarray, k: int, m: int) -> np.ndarray:
    """The least cost of each series cut at exactly k points."""
    best = np.full((len(n), int(n.max()) + 1), np.inf)
    best[:, 0] = 0.0
    for _ in range(k + 1):
        prior, best = best, np.full_like(best, np.inf)
        for t, cost in costs[m - 1 :]:
            best[:, t] = (prior[:, : t - m + 1] + cost[:, : t - m + 1]).min(axis=1)
    return best[np.arange(len(n)), n]


def _bisect(costs: list[tuple[int, np.ndarray]], n: np.ndarray, k: int, m: int) -> list[Outcome | EngineError]:
    """Exactly k change points by bisection of each series' own penalty, as for one series. costs: of all segments, by end.

    Each result tells for which penalties k change points can be no worse than those that it found. A series for which none are
    left, by far more than rounding, is given up; it would be after all steps.
    """
    out: list[Outcome | EngineError | None] = [None] * len(n)
    own, whole = np.arange(len(n)), np.array([costs[size - 1][1][i, 0] for i, size in enumerate(n)])  # own: the series still held
    state = {"low": np.zeros(len(n)), "high": np.maximum(1.0, whole), "least": _least(costs, n, k, m), "above": np.full(len(n), -np.inf), "below": np.full(len(n), np.inf)}
    margin = 1e-9 * state["high"]

    def run(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many change points each series gets by its penalty, and where its segments start."""
        best, back = _partitions(costs, beta, n[own], m)
        rows, at, found = np.arange(len(own)), n[own], np.zeros(len(own), dtype=np.int64)
        total = best[rows, at]
        while (at := back[rows, at]).any():
            found += at > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            border = (state["least"] - (total - beta * found)) / (found - k)
        state["above"] = np.where(found > k, np.fmax(state["above"], border), state["above"])
        state["below"] = np.where(found < k, np.fmin(state["below"], border), state["below"])
        return found, back

    def settle(found: np.ndarray, back: np.ndarray) -> None:
        """Takes down the series that have k change points or can have them by no penalty, and goes on with the others."""
        nonlocal costs, own
        none = (found != k) & (state["above"] > state["below"] + margin[own])
        for j in np.nonzero(none & np.array([out[i] is None for i in own]))[0]:
            out[own[j]] = InvalidInput(f"exact solution unreachable: no penalty gives {k} change points; use dynp")
        for j in np.nonzero(found == k)[0]:
            points = _path(back[j], int(n[own[j]]))
            total = np.array([costs[e - 1][1][j, s] for s, e in zip([0, *points[:-1]], points, strict=True)]).sum()
            out[own[j]] = Outcome(points, float(total))
        rest = np.array([out[i] is None for i in own])
        if not rest.all():
            own = own[rest]
            longest = int(n[own].max()) if len(own) else 0
            costs = [(t, c[rest]) for t, c in costs if t <= longest]
            for name, values in state.items():
                state[name] = values[rest]

    found, back = run(np.full(len(own), 1e-12))
    for j in np.nonzero(found < k)[0]:
        out[own[j]] = InvalidInput(f"exact solution unreachable: at most {found[j]} change points fit, {k} were asked for")
    settle(found, back)
    if not len(own):
        return out
    found, back = run(state["high"])
    while (more := (found > k) & (state["high"] < 1e300)).any():
        state["low"], state["high"] = np.where(more, state["high"], state["low"]), np.where(more, state["high"] * 4, state["high"])
        found, back = run(state["high"])
    for _ in range(80):
        settle(found, back)
        if not len(own):
            return out
        mid = (state["low"] + state["high"]) / 2
        found, back = run(mid)
        state["low"], state["high"] = np.where(found > k, mid, state["low"]), np.where(found > k, state["high"], mid)
    for i in own:
        out[i] = InvalidInput(f"exact solution unreachable: no penalty gives {k} change points; use dynp")
    return out


def together(detector: str, cost: str, stopping: Stopping, cons: Constraints, repro: str, options: dict | None, cost_options: dict | None) -> bool:
    """Whether the series of such a run can be taken in groups."""
    plain = not options and cons == Constraints(min_segment_len=cons.min_segment_len) and repro != "strict"
    if cost == "ar" and (cost_options or {}).get("p", 1) < 2:
        return False
    return plain and (detector, cost) in OPTIONS and not set(cost_options or {}) - OPTIONS[detector, cost] and stopping.kind != "path"


def _grouped(xs: list[np.ndarray], cost: str, stopping: Stopping, cons: Constraints, cost_options: dict) -> list[Outcome | EngineError]:
    group, m = Group([x[:, 0] for x in xs]), cons.min_segment_len
    if stopping.kind == "known_k":
        return _bisect(list(getattr(group, cost)(m, **cost_options)), group.n, stopping.k, m)
    params = make_cost(cost, xs[0], **cost_options).effective
    beta = np.array([stopping.penalties[0].beta(len(x), params) for x in xs])
    best, back = _partitions(getattr(group, cost)(m, **cost_options), beta, group.n, m)
    return [Outcome(_path(b, n), float(f[n])) for b, f, n in zip(back, best, group.n.tolist(), strict=True)]


def detect_many(xs: list[np.ndarray], detector: str, cost: str, stopping: Stopping, cons: Constraints, repro: str = "balanced", options: dict | None = None, cost_options: dict | None = None) -> list[Outcome | EngineError]:
    """detect() for each of some series; for a series that it refuses, the error."""
    out: list[Outcome | EngineError | None] = [None] * len(xs)
    alike = together(detector, cost, stopping, cons, repro, options, cost_options)
    held: list[int] = []

    def flush() -> None:
        for i, got in zip(held, _grouped([xs[i] for i in held], cost, stopping, cons, cost_options or {}) if held else [], strict=True):
            out[i] = got
        held.clear()

    # Series of like lengths make groups with little padding.
    for i in sorted(range(len(xs)), key=lambda i: len(xs[i])):
        x = xs[i]
        if alike and x.shape[1] == 1 and cons.min_segment_len <= len(x) <= LONGEST:
            if (len(held) + 1) * len(x) ** 2 > SQUARES:
                flush()
            held.append(i)
            continue
        try:
            out[i] = detect(x, detector, cost, stopping, cons, repro, options, cost_options)
        except EngineError as e:
            out[i] = e
    flush()
    return out
