"""Segment costs in numpy for the per-series kernels. cost(s, e) takes arrays of segment bounds [s, e)."""

from __future__ import annotations

import math

import numpy as np

from ..errors import InvalidInput, NotSupported

EPS = float(np.finfo(np.float64).eps)
VAR_FLOOR = EPS * 1e6
NIG_PRIOR = (0.0, 0.01, 1.0, 1.0)  # mean, pseudo-count, shape, scale


def matrix(x) -> np.ndarray:
    """A series as n x d doubles; missing and infinite values are refused, as by every cost."""
    x = np.asarray(x, dtype=np.float64)
    x = x[:, None] if x.ndim == 1 else x
    if x.ndim != 2 or x.shape[0] < 1 or x.shape[1] < 1:
        raise InvalidInput("a series needs at least one row and one column")
    if np.isnan(x).any():
        raise InvalidInput("the series has missing values")
    if np.isinf(x).any():
        raise InvalidInput("the series has infinite values")
    return x


def prefix(v: np.ndarray, exact: bool = False) -> np.ndarray:
    """Prefix sums with a leading zero row; exact: each rounded once (the strict mode)."""
    out = np.zeros((len(v) + 1, *v.shape[1:]))
    if exact:
        for j in range(v.shape[1]):
            total = comp = 0.0
            for i, x in enumerate(v[:, j]):
                new = total + x
                comp += (total - new) + x if abs(total) >= abs(x) else (x - new) + total
                total = new
                out[i + 1, j] = total + comp
    else:
        np.cumsum(v, axis=0, out=out[1:])
    return out


class Cost:
    """params: per dimension and segment; effective: all that a penalty counts."""

    name, params, subadditive = "", 2, False

    def __init__(self, x: np.ndarray, exact: bool = False):
        self.x, (self.n, self.d) = x, x.shape
        self.check()
        self.s1, self.s2 = prefix(x, exact), prefix(x * x, exact)

    def check(self) -> None:
        pass

    @property
    def effective(self) -> int:
        return self.d * self.params

    def _sums(self, s, e):
        s, e = np.atleast_1d(s), np.atleast_1d(e)
        return (e - s).astype(np.float64)[:, None], self.s1[e] - self.s1[s], self.s2[e] - self.s2[s]

    def cost(self, s, e) -> np.ndarray:
        raise NotImplementedError

    def one(self, s: int, e: int) -> float:
        return float(self.cost(np.array([s]), np.array([e]))[0])


class L2(Cost):
    """scale: of values in whole hundredths, whose sums are exact, a scale of 100 gives the costs of the values."""

    name, params, subadditive = "l2", 2, True

    def __init__(self, x, exact=False, scale: float = 1.0):
        super().__init__(x, exact)
        self.scale = scale

    def cost(self, s, e):
        m, a, b = self._sums(s, e)
        sse = np.maximum((b - a * a / m).sum(axis=1), 0.0)
        return sse / (self.scale * self.scale) if self.scale != 1 else sse


class Normal(Cost):
    name, params, subadditive = "normal", 3, True

    def cost(self, s, e):
        m, a, b = self._sums(s, e)
        var = b / m - (a / m) ** 2
        var = np.where(np.isnan(var) | (var < VAR_FLOOR), VAR_FLOOR, np.minimum(var, np.finfo(float).max))
        return (m * np.log(var)).sum(axis=1)


class NormalFullCov(Cost):
    name, params = "normal_full_cov", 3

    def __init__(self, x, exact=False):
        super().__init__(x, exact)
        self.cross = prefix((x[:, :, None] * x[:, None, :]).reshape(self.n, -1), exact)

    @property
    def effective(self) -> int:
        return self.d + self.d * (self.d + 1) // 2 + 1

    def cost(self, s, e):
        if self.d == 1:
            return Normal.cost(self, s, e)
        s, e = np.atleast_1d(s), np.atleast_1d(e)
        out = np.empty(len(np.broadcast_arrays(s, e)[0]))
        for i, (a, b) in enumerate(np.broadcast(s, e)):
            m = b - a
            mean = (self.s1[b] - self.s1[a]) / m
            cov = (self.cross[b] - self.cross[a]).reshape(self.d, self.d) / m - np.outer(mean, mean)
            ridge = max(1e-6 * np.trace(cov) / self.d, VAR_FLOOR)
            if m < self.d:
                ridge *= 1 + (self.d - m) / self.d
            out[i] = m * self._logdet(cov, ridge)
        return out

    def _logdet(self, cov: np.ndarray, ridge: float) -> float:
        for k in range(9):
            try:
                low = np.linalg.cholesky(cov + ridge * 10.0**k * np.eye(self.d))
            except np.linalg.LinAlgError:
                continue
            return float(2 * np.log(np.diag(low)).sum())
        return self.d * math.log(ridge * 1e8)


class L1(Cost):
    name, params = "l1", 2

    def cost(self, s, e):
        s, e = np.broadcast_arrays(np.atleast_1d(s), np.atleast_1d(e))
        return np.array([np.abs(self.x[a:b] - np.median(self.x[a:b], axis=0)).sum() for a, b in zip(s, e, strict=True)])


class Poisson(Cost):
    name, params = "poisson", 1

    def check(self):
        if (self.x < 0).any() or (np.abs(self.x - np.round(self.x)) > 1e-9).any():
            raise InvalidInput("poisson needs counts: integers >= 0")

    def cost(self, s, e):
        m, a, _ = self._sums(s, e)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a - a * np.log(a / m), 0.0).sum(axis=1)


class Bernoulli(Cost):
    name, params = "bernoulli", 1

    def check(self):
        if not np.isin(np.where(np.abs(self.x) <= 1e-12, 0, np.where(np.abs(self.x - 1) <= 1e-12, 1, self.x)), (0, 1)).all():
            raise InvalidInput("bernoulli needs zeros and ones")

    def cost(self, s, e):
        m, k, _ = self._sums(s, e)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = k / m
            return np.where((k > 0) & (k < m), -(k * np.log(p) + (m - k) * np.log1p(-p)), 0.0).sum(axis=1)


def lgamma_table(n: int, start: float) -> np.ndarray:
    """lnGamma(start + m / 2) for m = 0 .. n."""
    return np.array([math.lgamma(start + m / 2) for m in range(n + 1)])


class Nig(Cost):
    """Negative log marginal likelihood under a normal-inverse-gamma prior."""

    name, params = "nig", 3

    def __init__(self, x, exact=False):
        super().__init__(x, exact)
        self.table = lgamma_table(self.n, NIG_PRIOR[2])

    def cost(self, s, e):
        mu, kappa, alpha, beta = NIG_PRIOR
        m, a, b = self._sums(s, e)
        sse = np.maximum(b - a * a / m, 0.0)
        kn, an = kappa + m, alpha + m / 2
        bn = beta + 0.5 * sse + kappa * m * (a / m - mu) ** 2 / (2 * kn)
        lg = self.table[m[:, 0].astype(int)][:, None]
        log = lg - math.lgamma(alpha) + alpha * math.log(beta) - an * np.log(bn) + 0.5 * (math.log(kappa) - np.log(kn)) - 0.5 * m * math.log(2 * math.pi)
        return -log.sum(axis=1)


class Linear(Cost):
    name, params = "linear", 3

    def __init__(self, x, exact=False):
        super().__init__(x, exact)
        self.tx = prefix(x * np.arange(self.n)[:, None], exact)

    def cost(self, s, e):
        s, e = np.broadcast_arrays(np.atleast_1d(s), np.atleast_1d(e))
        m, a, b = self._sums(s, e)
        # Times counted from the segment's start keep the sums small.
        u = (m - 1) * m / 2
        sxx = (m - 1) * m * (2 * m - 1) / 6 - u * u / m
        sxy = self.tx[e] - self.tx[s] - s[:, None] * a - u * a / m
        syy = b - a * a / m
        with np.errstate(divide="ignore", invalid="ignore"):
            sse = np.where(sxx <= EPS * np.maximum(m, 1), syy, syy - sxy * sxy / sxx)
        return np.where(m <= 1, 0.0, np.maximum(sse, 0.0)).sum(axis=1)


class Ar(Cost):
    """Autoregression of order p: least squares with intercept for 1, Yule-Walker above."""

    name = "ar"

    def __init__(self, x, exact=False, p: int = 1):
        self.p, self.params = p, p + 2
        super().__init__(x, exact)
        lag = np.vstack([np.zeros((1, self.d)), x[:-1]])
        first = np.ones((self.n, 1))
        first[0] = 0
        self.xy, self.y1, self.y2 = prefix(x * lag, exact), prefix(lag, exact), prefix(lag * lag, exact)

    def cost(self, s, e):
        s, e = np.broadcast_arrays(np.atleast_1d(s), np.atleast_1d(e))
        if self.p > 1:
            return np.array([self._yule_walker(a, b) for a, b in zip(s, e, strict=True)])
        r = (e - s - 1).astype(float)[:, None]
        f = np.minimum(s + 1, e)
        diff = lambda c: c[e] - c[f]
        a, b, u, v, w = diff(self.s1), diff(self.s2), diff(self.y1), diff(self.y2), diff(self.xy)
        with np.errstate(divide="ignore", invalid="ignore"):
            sxx, sxy, syy = v - u * u / r, w - u * a / r, b - a * a / r
            sse = np.where(sxx <= EPS * np.maximum(np.abs(v), 1), syy, syy - sxy * sxy / sxx)
            out = r * np.log(np.maximum(np.maximum(sse, 0) / r, VAR_FLOOR))
        return np.where(r <= 1, 0.0, out).sum(axis=1)

    def _yule_walker(self, a: int, b: int) -> float:
        m, p, total = b - a, self.p, 0.0
        if m <= p + 1:
            return 0.0
        for j in range(self.d):
            y = self.x[a:b, j] - self.x[a:b, j].mean()
            cov = np.array([y[k:] @ y[: m - k] / m for k in range(p + 1)])
            phi, noise = levinson(cov)
            resid = y[p:] - sum(phi[k] * y[p - 1 - k : m - 1 - k] for k in range(p))
            r = m - p
            total += r * math.log(max(float(resid @ resid) / r, VAR_FLOOR))
        return total


def levinson(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and noise of an autoregression from autocovariances."""
    p = len(cov) - 1
    phi, noise = np.zeros(p), float(cov[0])
    for k in range(p):
        if noise <= VAR_FLOOR:
            break
        r = (cov[k + 1] - phi[:k] @ cov[k:0:-1]) / noise
        phi[:k] -= r * phi[:k][::-1]
        phi[k] = r
        noise *= 1 - r * r
    return phi, noise


def mid_ranks(v: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.signbit(v) ^ True, v))
    ranked = np.column_stack([v[order], np.signbit(v[order])])
    first = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])
    starts = np.nonzero(first)[0]
    sizes = np.diff(np.append(starts, len(v)))
    out = np.empty(len(v))
    out[order] = np.repeat(starts + (sizes + 1) / 2, sizes)
    return out


class Rank(L2):
    name, subadditive = "rank", True

    def __init__(self, x, exact=False):
        super().__init__(np.column_stack([mid_ranks(x[:, j]) for j in range(x.shape[1])]), exact)

    def cost(self, s, e):
        m, a, b = self._sums(s, e)
        return np.maximum(b - a * a / m, 0.0).sum(axis=1)


class Cosine(Cost):
    name, params = "cosine", 2

    def __init__(self, x, exact=False):
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        super().__init__(np.where(norm > 0, x / np.where(norm > 0, norm, 1), 0.0), exact)

    @property
    def effective(self) -> int:
        return self.d + 1

    def cost(self, s, e):
        m, a, _ = self._sums(s, e)
        return np.maximum(m[:, 0] - np.sqrt((a * a).sum(axis=1)), 0.0)


COSTS = {c.name: c for c in (L2, L1, Normal, NormalFullCov, Poisson, Bernoulli, Nig, Linear, Ar, Rank, Cosine)}


def make_cost(name: str, x: np.ndarray, exact: bool = False, **options) -> Cost:
    if name not in COSTS:
        raise NotSupported(f"unknown cost {name!r}; one of {', '.join(COSTS)}")
    return COSTS[name](x, exact, **options)
