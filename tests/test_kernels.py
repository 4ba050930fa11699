"""Costs and detectors on single series: against plain definitions and exhaustive search, and under transformations."""

import itertools

import numpy as np
import pytest

from driftline.config import Budget, Constraints, Penalty, Stopping
from driftline.errors import InvalidInput, NotSupported, ResourceLimit
from driftline.functions.cost_kernels import COSTS, make_cost, matrix
from driftline.operators import offline_kernels as K
from driftline.plans.api import detect_offline

DRAW = np.random.default_rng(7)
STEP = np.concatenate([DRAW.normal(0, 1, 40), DRAW.normal(6, 1, 35), DRAW.normal(-3, 1, 30)])


def naive(name, seg):
    m = len(seg)
    if name == "l2":
        return ((seg - seg.mean()) ** 2).sum()
    if name == "l1":
        return np.abs(seg - np.median(seg)).sum()
    if name == "normal":
        return m * np.log(max(seg.var(), 2.220446049250313e-10))
    if name == "linear":
        if m <= 1:
            return 0.0
        t = np.arange(m)
        return ((seg - np.polyval(np.polyfit(t, seg, 1), t)) ** 2).sum()
    if name == "cosine":
        return m - abs(np.sign(seg).sum())
    raise KeyError(name)


@pytest.mark.parametrize("name", ["l2", "l1", "normal", "linear", "cosine"])
def test_cost_equals_definition(name):
    cost = make_cost(name, matrix(STEP))
    for s, e in [(0, 5), (3, 50), (10, 12), (0, len(STEP)), (60, 105)]:
        assert cost.one(s, e) == pytest.approx(naive(name, STEP[s:e]), rel=1e-7, abs=1e-6)


def test_poisson_and_bernoulli_costs():
    counts = DRAW.poisson(3, 50).astype(float)
    total = counts[5:20].sum()
    assert make_cost("poisson", matrix(counts)).one(5, 20) == pytest.approx(total - total * np.log(total / 15))
    bits = (counts > 3).astype(float)
    p = bits[:30].mean()
    assert make_cost("bernoulli", matrix(bits)).one(0, 30) == pytest.approx(-30 * (p * np.log(p) + (1 - p) * np.log(1 - p)))
    with pytest.raises(InvalidInput):
        make_cost("poisson", matrix([1.5]))
    with pytest.raises(InvalidInput):
        make_cost("bernoulli", matrix([2.0]))


def test_full_covariance_matches_numpy():
    x = DRAW.normal(size=(60, 3))
    got = make_cost("normal_full_cov", x).one(10, 50)
    cov = np.cov(x[10:50], rowvar=False, bias=True)
    ridge = 1e-6 * np.trace(cov) / 3
    assert got == pytest.approx(40 * np.linalg.slogdet(cov + ridge * np.eye(3))[1], rel=1e-9)


def test_ar_cost_is_least_squares():
    x = STEP[:30]
    y, z = x[1:], np.column_stack([np.ones(29), x[:-1]])
    sse = np.linalg.lstsq(z, y, rcond=None)[1][0]
    assert make_cost("ar", matrix(x)).one(0, 30) == pytest.approx(29 * np.log(sse / 29), rel=1e-7)
    assert np.isfinite(make_cost("ar", matrix(x), p=3).one(0, 30))


def test_exact_prefixes_agree():
    assert make_cost("l2", matrix(STEP), True).one(3, 90) == pytest.approx(make_cost("l2", matrix(STEP)).one(3, 90))


@pytest.mark.parametrize("bad", [[np.nan, 1.0], [np.inf, 1.0], np.zeros((0, 1))])
def test_missing_infinite_and_empty_series_are_refused(bad):
    with pytest.raises(InvalidInput):
        matrix(bad)


def brute(cost, k, m):
    n, best = cost.n, (np.inf, None)
    for cps in itertools.combinations(range(1, n), k):
        ends = [*cps, n]
        if all(b - a >= m for a, b in zip([0, *cps], ends, strict=True)):
            value = K.objective(cost, ends)
            if value < best[0] - 1e-12:
                best = (value, ends)
    return best


@pytest.mark.parametrize("name", ["l2", "normal", "nig"])
@pytest.mark.parametrize("m", [1, 2, 4])
def test_dynp_and_pelt_reach_the_optimum(name, m):
    for seed in range(3):
        x = matrix(np.random.default_rng(seed).normal(size=13) + (np.arange(13) > 6) * 2)
        cost, cons = make_cost(name, x), Constraints(min_segment_len=m)
        for k in (1, 2):
            assert K.dynp(cost, Stopping.known(k), cons).objective == pytest.approx(brute(cost, k, m)[0])
        for beta in (0.5, 2.0):
            best = min(brute(cost, k, m)[0] + beta * k for k in range(13 // m) if brute(cost, k, m)[1])
            assert K.pelt(cost, Stopping.penalized(beta), cons).objective == pytest.approx(best)


def test_known_changes_are_found_by_all_detectors():
    cost, cons = make_cost("l2", matrix(STEP)), Constraints(min_segment_len=5)
    for name in ("pelt", "fpop", "binseg", "wbs", "dynp", "bottom_up"):
        got = K.detect(matrix(STEP), name, "l2", Stopping.known(2) if name == "dynp" else Stopping.penalized(20.0), cons).change_points
        assert len(got) == 2 and abs(got[0] - 40) <= 1 and abs(got[1] - 75) <= 1, name
    got = K.sliding_window(cost, Stopping.known(2), Constraints(min_segment_len=10)).change_points
    assert abs(got[0] - 40) <= 1 and abs(got[1] - 75) <= 1
    for kernel in ("rbf", "linear"):
        got = K.kernel_cpd(matrix(STEP), Stopping.known(2), cons, kernel).change_points
        assert abs(got[0] - 40) <= 1 and abs(got[1] - 75) <= 1
    assert abs(K.gp_cpd(matrix(STEP[:75]), Stopping.known(1), cons).change_points[0] - 40) <= 2
    assert len(K.argp_cpd(matrix(STEP[:60]), Stopping.known(1), cons).change_points) == 1


def test_constant_series_have_no_changes():
    for name in ("pelt", "binseg", "bottom_up", "wbs", "window"):
        assert K.detect(matrix(np.full(60, 3.0)), name, "l2", Stopping(), Constraints()).change_points == []


def test_shift_scale_and_column_order_do_not_matter():
    x = DRAW.normal(size=(80, 2)) + (np.arange(80)[:, None] > 40) * 4
    base = K.detect(x, "pelt", "normal", Stopping(), Constraints(min_segment_len=4)).change_points
    for y in (x + 100, x * 3, x[:, ::-1]):
        assert K.detect(y, "pelt", "normal", Stopping(), Constraints(min_segment_len=4)).change_points == base


def test_limits_and_unsupported_requests():
    cost = make_cost("l2", matrix(STEP))
    with pytest.raises(ResourceLimit):
        K.pelt(cost, Stopping(), Constraints(), Budget(max_evals=5))
    assert K.pelt(cost, Stopping(), Constraints(), Budget(max_evals=5, soft=True)).warnings
    with pytest.raises(ResourceLimit):
        K.dynp(cost, Stopping.known(1), Constraints(memory_budget_bytes=100))
    for run in (K.binseg, K.wbs, K.bottom_up, K.sliding_window):
        with pytest.raises(NotSupported):
            run(cost, Stopping.path([1.0, 2.0]), Constraints())
    with pytest.raises(NotSupported):
        K.fpop(make_cost("l1", matrix(STEP)), Stopping(), Constraints())
    with pytest.raises(InvalidInput):
        Penalty("manual", -1.0)
    with pytest.raises(InvalidInput):
        Constraints(min_segment_len=0)


def test_constraints_hold():
    cons = Constraints(min_segment_len=6, jump=3, max_change_points=2)
    for name in ("pelt", "binseg", "wbs", "bottom_up", "dynp"):
        points = K.detect(matrix(STEP), name, "l2", Stopping.penalized(1.0), cons).breakpoints
        assert len(points) <= 3 and all(p % 3 == 0 for p in points[:-1])
        assert all(b - a >= 6 for a, b in zip([0, *points], points, strict=False))


def test_penalty_path_gives_the_first_result():
    cost = make_cost("l2", matrix(STEP))
    path = K.pelt(cost, Stopping.path([20.0, 1.0]), Constraints())
    assert path.breakpoints == K.pelt(cost, Stopping.penalized(20.0), Constraints()).breakpoints and len(path.notes) == 2


def test_intervals_are_feasible_and_repeatable():
    splits = np.array(Constraints(min_segment_len=3).candidates(90))
    for strategy in ("random", "grid", "stratified"):
        got = K.wbs_intervals(90, 3, splits, strategy, 40, seed=5)
        assert got == K.wbs_intervals(90, 3, splits, strategy, 40, seed=5) and 0 < len(got) <= 40
        assert all(0 <= s < e <= 90 and e - s >= 6 for s, e in got)
    assert K.spread(list(range(10)), 3) == [0, 4, 9]


def test_detect_offline_front_end():
    assert detect_offline(STEP, detector="pelt", cost="l2", stopping={"pen": 20.0}, constraints={"min_segment_len": 5}).change_points == detect_offline(STEP, pipeline={"detector": "pelt", "stopping": {"pen": 20.0}, "constraints": {"min_segment_len": 5}}).change_points
    with pytest.raises(InvalidInput):
        detect_offline(STEP, pipeline={"detector": "pelt"}, cost="l2")
    with pytest.raises(InvalidInput):
        detect_offline(STEP, pipeline={"detector": "pelt", "colour": 1})


def test_all_costs_are_finite_on_short_segments():
    x = matrix(np.array([0.0, 1.0, 1.0, 0.0, 1.0]))
    for name in COSTS:
        assert np.isfinite(make_cost(name, x).cost(np.array([0, 1, 2]), np.array([2, 2 + 1, 5]))).all(), name
