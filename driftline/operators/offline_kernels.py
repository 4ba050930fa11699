"""Offline detectors over one series, in numpy. Each returns the breakpoints: ends of segments, the last one being n."""

from __future__ import annotations

import heapq
import math

import numpy as np

from ..config import Budget, Constraints, Stopping
from ..errors import InvalidInput, NotSupported, ResourceLimit
from ..functions.cost_kernels import Cost, make_cost

_MASK = (1 << 64) - 1


class Outcome:
    """Breakpoints with the objective and notes of a run."""

    def __init__(self, breakpoints: list[int], objective: float | None = None, notes: list[str] | None = None, warnings: list[str] | None = None):
        self.breakpoints, self.objective = [int(b) for b in breakpoints], objective
        self.notes, self.warnings = notes or [], warnings or []

    @property
    def change_points(self) -> list[int]:
        return self.breakpoints[:-1]


def objective(cost: Cost, breakpoints: list[int], beta: float = 0.0) -> float:
    starts = [0, *breakpoints[:-1]]
    return float(cost.cost(np.array(starts), np.array(breakpoints)).sum()) + beta * (len(breakpoints) - 1)


def _follow(back: np.ndarray, n: int) -> list[int]:
    out = [n]
    while back[out[-1]] > 0:
        out.append(int(back[out[-1]]))
    return out[::-1]


def _partition(cost: Cost, betas: list[float], cons: Constraints, prune: str, budget: Budget) -> list[tuple[list[int], float]]:
    """Optimal partitioning for several penalties at once, with their objectives; the segment costs of a step serve all of them.

    prune: exact drops a start only min_segment_len steps after it lost, and only for costs that never rise by a split;
    reference drops it at once for any cost; none keeps all. Starts that tie with the penalty added count as equal, so that one that
    ties is no loser where pruning is exact.
    """
    n, m = cost.n, cons.min_segment_len
    ends = [*cons.candidates(n), n]
    f = np.full((len(betas), n + 1), np.inf)
    f[:, 0] = np.negative(betas)
    back = np.zeros((len(betas), n + 1), dtype=np.int64)
    alive = [np.array([0]) for _ in betas]
    lost: list[list[tuple[int, np.ndarray]]] = [[] for _ in betas]
    effective = prune if prune != "exact" or cost.subadditive else "none"
    for t in ends:
        union = np.unique(np.concatenate(alive)) if len(betas) > 1 else alive[0]
        ready = union[: np.searchsorted(union, t - m, side="right")]
        if not len(ready):
            for k in range(len(betas)):
                alive[k] = np.append(alive[k], t)
            continue
        costs = cost.cost(ready, np.full(len(ready), t))
        budget.spend(len(ready))
        for k, beta in enumerate(betas):
            own, c = ready, costs
            if len(betas) > 1:
                own = alive[k][: np.searchsorted(alive[k], t - m, side="right")]
                c = costs[np.searchsorted(ready, own)]
            bare = f[k, own] + c
            loss = bare + beta
            i = int(np.argmin(loss)) if len(loss) else 0  # ties: the smaller start
            if len(loss) and loss[i] < np.inf:
                f[k, t], back[k, t] = loss[i], own[i]
                if effective != "none":
                    drop = own[bare > f[k, t] if effective == "exact" else bare >= f[k, t]]
                    if effective == "exact":
                        if len(drop):
                            lost[k].append((t, drop))
                        due = [d for at, d in lost[k] if t - at >= m]
                        if due:
                            lost[k] = [(at, d) for at, d in lost[k] if t - at < m]
                        drop = np.concatenate(due) if due else drop[:0]
                    if len(drop):
                        at = np.searchsorted(alive[k], drop)
                        here = alive[k][np.minimum(at, len(alive[k]) - 1)] == drop  # a start may have lost more than once
                        alive[k] = np.delete(alive[k], at[here])
            alive[k] = np.append(alive[k], t)
    return [(_follow(b, n), float(g[n])) for b, g in zip(back, f, strict=True)]


def _default(value, cost: Cost, stopping: Stopping) -> list[float]:
    return [p.beta(cost.n, value if value else cost.effective) for p in stopping.penalties]


def pelt(cost: Cost, stopping: Stopping, cons: Constraints, budget: Budget | None = None, prune: str = "exact", params: int | None = None) -> Outcome:
    budget = budget or Budget(cons.max_cost_evals, cons.time_budget_ms)
    if stopping.kind == "known_k":
        return _bisect(cost, stopping.k, cons, budget)
    betas = _default(params, cost, stopping)
    if cons.max_change_points is not None:
        return dynp(cost, stopping, cons, budget)
    found = _partition(cost, betas, cons, prune, budget)
    notes = [f"penalty_path[{i}]: beta={b:.6g}, change_points={len(p) - 1}" for i, (b, (p, _)) in enumerate(zip(betas, found, strict=True))] if len(betas) > 1 else []
    points, total = found[0]
    return Outcome(points, total if math.isfinite(total) else objective(cost, points, betas[0]), notes, budget.warnings)


def _bisect(cost: Cost, k: int, cons: Constraints, budget: Budget) -> Outcome:
    """Exactly k change points by bisection of the penalty, without pruning; an error if no penalty gives them."""
    low, high = 0.0, max(1.0, cost.cost(np.array([0]), np.array([cost.n]))[0])
    run = lambda b: _partition(cost, [b], cons, "none", budget)[0][0]
    found = run(1e-12)
    if len(found) - 1 == k:
        return Outcome(found, objective(cost, found))
    if len(found) - 1 < k:
        raise InvalidInput(f"exact solution unreachable: at most {len(found) - 1} change points fit, {k} were asked for")
    while len(found := run(high)) - 1 > k and high < 1e300:
        low, high = high, high * 4
    for _ in range(80):
        if len(found) - 1 == k:
            return Outcome(found, objective(cost, found))
        mid = (low + high) / 2
        found = run(mid)
        if len(found) - 1 > k:
            low = mid
        else:
            high = mid
    raise InvalidInput(f"exact solution unreachable: no penalty gives {k} change points; use dynp")


def fpop(cost: Cost, stopping: Stopping, cons: Constraints, budget: Budget | None = None, prune: str = "exact", params: int | None = None) -> Outcome:
    if cost.name != "l2":
        raise NotSupported("fpop works with the l2 cost only")
    return pelt(cost, stopping, cons, budget, prune, params)


def dynp(cost: Cost, stopping: Stopping, cons: Constraints, budget: Budget | None = None, **_) -> Outcome:
    """Exact segmentation for every number of change points by one sweep."""
    budget = budget or Budget(cons.max_cost_evals, cons.time_budget_ms)
    n, m = cost.n, cons.min_segment_len
    ends = np.array([*cons.candidates(n), n])
    starts = np.array([0, *ends[:-1]])
    known = stopping.kind == "known_k"
    most = stopping.k if known else min(len(ends) - 1, n // m - 1 if n >= m else 0)
    if cons.max_change_points is not None:
        most = min(most, cons.max_change_points)
    need = 16 * (most + 1) * (len(ends) + 1) + 16 * len(ends)
    if cons.memory_budget_bytes is not None and need > cons.memory_budget_bytes:
        raise ResourceLimit(f"dynp needs about {need} bytes; the budget is {cons.memory_budget_bytes}")
    # best[k, p]: the least cost up to start p by k change points. The costs of the segments that stop at one end serve all k.
    best = np.full((most + 1, len(ends) + 1), np.inf)
    back = np.zeros((most + 1, len(ends) + 1), dtype=np.int64)
    levels = np.arange(most)
    for j, e in enumerate(ends, 1):
        q = int(np.searchsorted(starts, e - m, side="right"))
        if not q:
            continue
        costs = cost.cost(starts[:q], np.full(q, e))
        budget.spend(q)
        best[0, j] = costs[0]
        if most and q > 1:
            value = best[:most, 1:q] + costs[1:]
            at = np.argmin(value, axis=1)  # ties: the smaller start
            best[1:, j], back[1:, j] = value[levels, at], at + 1
    totals = best[:, -1]

    def path(k: int) -> list[int]:
        j, out = len(ends), [n]
        for level in range(k, 0, -1):
            j = int(back[level, j])
            out.append(int(starts[j]))
        return out[::-1]

    if known:
        if stopping.k >= len(totals) or not np.isfinite(totals[stopping.k]):
            raise InvalidInput(f"{stopping.k} change points do not fit the constraints")
        return Outcome(path(stopping.k), float(totals[stopping.k]))
    betas = _default(None, cost, stopping)
    picks = [int(np.argmin(totals + b * np.arange(len(totals)))) for b in betas]
    return Outcome(path(picks[0]), float(totals[picks[0]] + betas[0] * picks[0]), [f"penalty_path[{i}]: change_points={k}" for i, k in enumerate(picks)] if len(picks) > 1 else [])


def _best_split(cost: Cost, s: int, e: int, splits: np.ndarray, m: int, budget: Budget) -> tuple[float, int] | None:
    own = splits[np.searchsorted(splits, s + m) : np.searchsorted(splits, e - m, side="right")]
    if not len(own):
        return None
    budget.spend(2 * len(own) + 1)
    gain = cost.one(s, e) - cost.cost(np.full(len(own), s), own) - cost.cost(own, np.full(len(own), e))
    i = int(np.argmax(gain))  # ties: the smaller split
    return float(gain[i]), int(own[i])


def _greedy(cost: Cost, stopping: Stopping, cons: Constraints, budget: Budget, best, params: int | None, warnings: list[str]) -> Outcome:
    """Take the best split of any segment again and again: gain descending, then split, then start."""
    if stopping.kind == "path":
        raise NotSupported("a penalty path is not supported by this detector")
    n = cost.n
    beta = None if stopping.kind == "known_k" else _default(params, cost, stopping)[0]
    most = stopping.k if beta is None else cons.max_change_points
    frontier, found = [], []

    def push(s: int, e: int, depth: int) -> None:
        if cons.max_depth is not None and depth >= cons.max_depth:
            return
        got = best(s, e)
        if got:
            heapq.heappush(frontier, (-got[0], got[1], s, e, depth))

    push(0, n, 0)
    while frontier and (most is None or len(found) < most):
        gain, split, s, e, depth = heapq.heappop(frontier)
        if beta is not None and -gain <= beta:
            break
        found.append(split)
        push(s, split, depth + 1)
        push(split, e, depth + 1)
    if beta is None and len(found) < stopping.k:
        raise InvalidInput(f"only {len(found)} change points fit; {stopping.k} were asked for")
    points = [*sorted(found), n]
    return Outcome(points, objective(cost, points, beta or 0.0), [], warnings + budget.warnings)


def binseg(cost: Cost, stopping: Stopping, cons: Constraints, budget: Budget | None = None, params: int | None = None, **_) -> Outcome:
    budget = budget or Budget(cons.max_cost_evals, cons.time_budget_ms)
    splits = np.array(cons.candidates(cost.n), dtype=np.int64)
    best = lambda s, e: _best_split(cost, s, e, splits, cons.min_segment_len, budget)
    return _greedy(cost, stopping, cons, budget, best, params, ["binary segmentation can mask changes that lie close together"])


class StableRng:
    """A 64-bit mixing generator; ranges by remainder."""

    def __init__(self, seed: int):
        self.state = (seed + 0x9E3779B97F4A7C15) & _MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _MASK
        z = self.state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & _MASK
        return z ^ (z >> 31)

    def below(self, n: int) -> int:
        return self.next() % n


def dyadic_lengths(n: int, m: int) -> list[int]:
    out, size = set(), n
    while size >= 2 * m:
        out.add(size)
        if size == 2 * m:
            break
        size = max(size // 2, 2 * m)
    return sorted(out)


def spread(items: list, target: int) -> list:
    """target of the sorted items, evenly: all if they are no more, the middle one if one is wanted, else both ends and those
    at equal steps between them, rounded down."""
    n = len(items)
    if n <= target:
        return list(items)
    if target <= 1:
        return [items[n // 2]] * max(target, 0)
    return [items[i * (n - 1) // (target - 1)] for i in range(target)]


# What the seeds of the stratified intervals and of the random ones that fill them up differ by.
STRATIFIED_SEED, FILL_SEED = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def wbs_intervals(n: int, m: int, splits: np.ndarray, strategy: str = "random", target: int | None = None, seed: int = 0) -> list[tuple[int, int]]:
    """Intervals that hold a feasible split: random, a dyadic grid, or stratified by dyadic length."""
    target = max(100, math.ceil(5 * math.sqrt(n))) if target is None else target
    if n < 2 * m or not target:
        return []
    feasible = lambda s, e: np.searchsorted(splits, s + m) < np.searchsorted(splits, e - m, side="right")

    def random(count: int, seed: int) -> list[tuple[int, int]]:
        rng, out = StableRng(seed), []
        for _ in range(max(64 * count, 4096)):
            if len(out) >= count:
                break
            s = rng.below(n - 1)
            if n - s < 2 * m:
                continue
            e = s + 2 * m + rng.below(n - s - 2 * m + 1)
            if feasible(s, e):
                out.append((s, e))
        return spread(sorted(set(out)), count)

    if strategy == "random":
        return random(target, seed)
    if strategy == "grid":
        every = [iv for iv in dyadic_grid(n, m) if feasible(*iv)]
        total = len(every)
        return every if total <= target else [iv for i, iv in enumerate(every) if (i + 1) * target // total > i * target // total]
    if strategy != "stratified":
        raise InvalidInput(f"unknown interval strategy {strategy!r}")
    lengths, rng, out = dyadic_lengths(n, m), StableRng(seed ^ STRATIFIED_SEED), []
    for i, size in enumerate(lengths):
        goal = target // len(lengths) + (i < target % len(lengths))
        taken = 0
        for _ in range(max(64 * goal, 256) if goal else 0):
            if taken >= goal:
                break
            s = rng.below(n - size + 1)
            if feasible(s, s + size):
                out.append((s, s + size))
                taken += 1
    if len(out) < target:
        out += random(target - len(out), seed ^ FILL_SEED)
    return spread(sorted(set(out)), target)


def dyadic_grid(n: int, m: int) -> list[tuple[int, int]]:
    """All dyadic intervals at half steps, and the one at the end where the steps miss it."""
    out = []
    for size in dyadic_lengths(n, m):
        step = max(size // 2, 1)
        out += [(s, s + size) for s in range(0, n - size + 1, step)]
        if n > size and (n - size) % step:
            out.append((n - size, n))
    return out


def wbs(cost: Cost, stopping: Stopping, cons: Constraints, budget: Budget | None = None, params: int | None = None, strategy: str = "random", intervals: int | None = None, seed: int = 0, **_) -> Outcome:
    budget = budget or Budget(cons.max_cost_evals, cons.time_budget_ms)
    m = cons.min_segment_len
    splits = np.array(cons.candidates(cost.n), dtype=np.int64)
    found = [(s, e, _best_split(cost, s, e, splits, m, budget)) for s, e in wbs_intervals(cost.n, m, splits, strategy, intervals, seed)]

    def best(s: int, e: int) -> tuple[float, int] | None:
        own = [g for a, b, g in found if g and s <= a and b <= e]
        whole = _best_split(cost, s, e, splits, m, budget)
        own += [whole] if whole else []
        return max(own, key=lambda g: (g[0], -g[1])) if own else None

    return _greedy(cost, stopping, cons, budget, best, params, [])


def bottom_up(cost: Cost, stopping: Stopping, cons: Constraints, budget: Budget | None = None, params: int | None = None, **_) -> Outcome:
    """Start from short segments and merge the pair that costs least, by a heap whose stale entries are skipped."""
    if stopping.kind == "path":
        raise NotSupported("a penalty path is not supported by this detector")
    budget = budget or Budget(cons.max_cost_evals, cons.time_budget_ms)
    n, m = cost.n, cons.min_segment_len
    splits, points, cursor = cons.candidates(n), [], 0
    for s in splits:
        if s >= cursor + m and n - s >= m:
            points.append(s)
            cursor = s
    beta = None if stopping.kind == "known_k" else _default(params, cost, stopping)[0]
    most = stopping.k if beta is None else cons.max_change_points
    if beta is None and len(points) < stopping.k:
        raise InvalidInput(f"only {len(points)} change points fit; {stopping.k} were asked for")
    left, right = {}, {}
    edges = [0, *points, n]
    for a, b in zip(edges, edges[1:], strict=False):
        right[a], left[b] = b, a
    price = {(a, right[a]): cost.one(a, right[a]) for a in edges[:-1]}
    heap: list = []

    def offer(p: int) -> None:
        a, b = left[p], right[p]
        budget.spend()
        price[a, b] = cost.one(a, b)
        heapq.heappush(heap, (price[a, b] - price[a, p] - price[p, b], p, a, b))

    for p in points:
        offer(p)
    alive = set(points)
    while heap:
        delta, p, a, b = heapq.heappop(heap)
        if p not in alive or left[p] != a or right[p] != b:
            continue
        forced = most is not None and len(alive) > most
        if not forced and (beta is None or delta > beta):
            break
        alive.discard(p)
        right[a], left[b] = b, a
        for q in (a, b):
            if q in alive:
                offer(q)
    found = [*sorted(alive), n]
    return Outcome(found, objective(cost, found, beta or 0.0))


def window_scores(cost: Cost, splits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits with room for half a window on either side, and the drop in cost that splitting the window there gives."""
    h = width // 2
    own = splits[(splits >= h) & (splits <= cost.n - h)]
    return own, cost.cost(own - h, own + h) - cost.cost(own - h, own) - cost.cost(own, own + h) if len(own) else np.zeros(0)


def local_peaks(score: np.ndarray) -> np.ndarray:
    """Above the left neighbour and not below the right one; all places if there is none."""
    left, right = np.append(-np.inf, score[:-1]), np.append(score[1:], -np.inf)
    at = np.nonzero((score > left) & (score >= right))[0]
    return at if len(at) else np.arange(len(score))


def sliding_window(cost: Cost, stopping: Stopping, cons: Constraints, budget: Budget | None = None, params: int | None = None, width: int = 20, **_) -> Outcome:
    if stopping.kind == "path":
        raise NotSupported("a penalty path is not supported by this detector")
    if width < 2 or width % 2:
        raise InvalidInput("the window width must be even and at least 2")
    splits, score = window_scores(cost, np.array(cons.candidates(cost.n), dtype=np.int64), width)
    known = stopping.kind == "known_k"
    pick = np.arange(len(score)) if known else local_peaks(score)
    beta = None if known else _default(params, cost, stopping)[0]
    most = stopping.k if known else cons.max_change_points
    chosen: list[int] = []
    for i in sorted(pick, key=lambda i: (-score[i], splits[i])):
        if most is not None and len(chosen) >= most or beta is not None and score[i] <= beta:
            break
        if all(abs(splits[i] - c) >= cons.min_segment_len for c in chosen):
            chosen.append(int(splits[i]))
    if known and len(chosen) < stopping.k:
        raise InvalidInput(f"only {len(chosen)} change points fit; {stopping.k} were asked for")
    found = [*sorted(chosen), cost.n]
    return Outcome(found, objective(cost, found, beta or 0.0))


class KernelCost(Cost):
    """Within-segment scatter in a kernel's feature space, from two-way prefix sums of the Gram matrix."""

    name, params, subadditive, limit = "kernel", 1, True, 20_000

    def __init__(self, x: np.ndarray, kernel: str = "rbf", gamma: float | None = None):
        self.x, (self.n, self.d) = x, x.shape
        if self.n > self.limit:
            raise NotSupported(f"the Gram matrix of {self.n} rows is too large; at most {self.limit}")
        if kernel == "linear":
            gram = x @ x.T
        elif kernel == "rbf":
            sq = (x * x).sum(axis=1)
            dist = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0.0)
            if gamma is None:
                some = dist[np.triu_indices(self.n, 1)]
                some = some[some > 0]
                gamma = 1 / (2 * some.mean()) if len(some) else 1.0
            gram = np.exp(-gamma * dist)
        else:
            raise InvalidInput(f"unknown kernel {kernel!r}")
        self.diag = np.concatenate([[0.0], np.cumsum(np.diag(gram))])
        self.block = np.zeros((self.n + 1, self.n + 1))
        self.block[1:, 1:] = gram.cumsum(axis=0).cumsum(axis=1)

    def cost(self, s, e):
        s, e = np.broadcast_arrays(np.atleast_1d(s), np.atleast_1d(e))
        b = self.block
        inner = b[e, e] - b[s, e] - b[e, s] + b[s, s]
        return np.maximum(self.diag[e] - self.diag[s] - inner / (e - s), 0.0)


def kernel_cpd(x: np.ndarray, stopping: Stopping, cons: Constraints, kernel: str = "rbf", gamma: float | None = None) -> Outcome:
    return dynp(KernelCost(x, kernel, gamma), stopping, cons)


class GpCost(Cost):
    """Negative log marginal likelihood of a Gaussian process on each segment, remembered by segment."""

    name, params = "gp", 3

    def __init__(self, x: np.ndarray, kernel: str = "rbf", length: float = 8.0, variance: float = 1.0, noise: float = 1e-3, ar_weight: float = 0.0, ar_decay: float = 3.0):
        if x.shape[1] != 1:
            raise NotSupported("the Gaussian process detectors take one column")
        self.x, (self.n, self.d) = x, x.shape
        lag = np.arange(self.n, dtype=float)
        if kernel == "rbf":
            base = variance * np.exp(-0.5 * (lag / length) ** 2)
        elif kernel == "matern32":
            z = math.sqrt(3) * lag / length
            base = variance * (1 + z) * np.exp(-z)
        else:
            raise InvalidInput(f"unknown kernel {kernel!r}")
        self.row = base + ar_weight * np.exp(-lag / ar_decay)
        self.noise, self.known = noise, {}

    def cost(self, s, e):
        return np.array([self._nll(int(a), int(b)) for a, b in np.broadcast(np.atleast_1d(s), np.atleast_1d(e))])

    def _nll(self, s: int, e: int) -> float:
        got = self.known.get((s, e))
        if got is None:
            m = e - s
            at = np.arange(m)
            cov = self.row[np.abs(at[:, None] - at)]
            y = self.x[s:e, 0] - self.x[s:e, 0].mean()
            for k in range(7):
                try:
                    low = np.linalg.cholesky(cov + (self.noise + (1e-9 * 10.0**k if k else 0.0)) * np.eye(m))
                    break
                except np.linalg.LinAlgError:
                    if k == 6:
                        raise ResourceLimit("the covariance stays singular") from None
            z = np.linalg.solve(low, y)
            got = self.known[s, e] = float(0.5 * z @ z + np.log(np.diag(low)).sum() + 0.5 * m * math.log(2 * math.pi))
        return got


def gp_cpd(x: np.ndarray, stopping: Stopping, cons: Constraints, **kernel) -> Outcome:
    """Binary segmentation on the likelihood; a path gives the first penalty's result."""
    if stopping.kind == "path":
        stopping = Stopping("penalized", None, stopping.penalties[:1])
    return binseg(GpCost(x, **kernel), stopping, cons)


def argp_cpd(x: np.ndarray, stopping: Stopping, cons: Constraints, weight: float = 0.75, decay: float = 3.0, **kernel) -> Outcome:
    return gp_cpd(x, stopping, cons, ar_weight=weight, ar_decay=decay, **kernel)


DETECTORS = {"pelt": pelt, "fpop": fpop, "binseg": binseg, "wbs": wbs, "dynp": dynp, "segneigh": dynp, "bottom_up": bottom_up, "window": sliding_window}
SELF_COSTED = {"kernel": kernel_cpd, "gp": gp_cpd, "argp": argp_cpd}


def detect(x: np.ndarray, detector: str, cost: str, stopping: Stopping, cons: Constraints, repro: str = "balanced", options: dict | None = None, cost_options: dict | None = None) -> Outcome:
    """One detector on one series, of which missing and infinite values are refused."""
    options = options or {}
    if detector in SELF_COSTED:
        return SELF_COSTED[detector](x, stopping, cons, **options)
    if detector not in DETECTORS:
        raise NotSupported(f"unknown detector {detector!r}")
    model = make_cost("l2" if detector == "fpop" and not cost else cost or "l2", x, repro == "strict", **(cost_options or {}))
    return DETECTORS[detector](model, stopping, cons, **options)
