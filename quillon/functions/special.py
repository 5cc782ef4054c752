"""Special functions on numpy arrays, and the same as Spark Columns by Arrow functions.

Gamma and beta prefactors are taken in saddle-point form (Loader 2000), the incomplete functions by power series and by continued
fractions (modified Lentz), inverses by bisection over the bit patterns of doubles. A null argument counts as NaN; NaN gives NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

LN_SQRT_2PI = 0.5 * math.log(2 * math.pi)
_TINY, _EPS = 1e-300, 1e-16
_MOST = 20_000


def _each(f: Callable[[float], float]) -> Callable[[np.ndarray], np.ndarray]:
    """A function of the C library over an array."""
    return lambda x: np.asarray(np.frompyfunc(f, 1, 1)(np.asarray(x, float)), float)


def _safe_gamma(x: float) -> float:
    if math.isnan(x) or x == -math.inf:
        return math.nan
    try:
        return math.gamma(x)
    except OverflowError:
        return math.inf
    except ValueError:  # poles
        return math.copysign(math.inf, x) if x == 0 else math.nan


def _safe_lgamma(x: float) -> float:
    """ln Gamma; NaN where Gamma is negative, infinite at the poles."""
    if math.isnan(x) or x == -math.inf:
        return math.nan
    if x <= 0 and x == math.floor(x):
        return math.inf
    if x < 0 and math.floor(x) % 2:
        return math.nan
    try:
        return math.lgamma(x)
    except OverflowError:
        return math.inf


erf, erfc, gamma, lgamma = _each(math.erf), _each(math.erfc), _each(_safe_gamma), _each(_safe_lgamma)


def erfcx(x) -> np.ndarray:
    """exp(x^2) erfc(x), for large x by a continued fraction."""
    x = np.asarray(x, float)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        near = np.exp(np.minimum(x * x, 700)) * erfc(x)
        f = np.zeros_like(x)
        for k in range(60, 0, -1):
            f = k / 2 / (x + f)
        return np.where(x > 5, 1 / (math.sqrt(math.pi) * (x + f)), np.where(x < -26, np.inf, near))


#: zeta(k) for k = 2, 3, ..., by sums and their Euler-Maclaurin tail.
_ZETA = [sum(n**-k for n in range(1, 30)) + 30.0 ** (1 - k) / (k - 1) + 0.5 * 30.0**-k + k * 30.0 ** (-k - 1) / 12 - k * (k + 1) * (k + 2) * 30.0 ** (-k - 3) / 720 for k in range(2, 40)]


def lgamma1p(a) -> np.ndarray:
    """ln Gamma(1 + a), with full relative accuracy near 0."""
    a = np.asarray(a, float)
    s = np.zeros_like(a)
    with np.errstate(over="ignore", invalid="ignore"):
        small = np.where(np.abs(a) <= 0.3, a, 0.0)
        for k in range(len(_ZETA) - 1, -1, -1):
            s = (-1) ** k * _ZETA[k] / (k + 2) + s * small
        return np.where(np.abs(a) <= 0.3, small * (s * small - np.euler_gamma), lgamma(1 + a))


def stirling(n) -> np.ndarray:
    """ln Gamma(n + 1) - ln(sqrt(2 pi n) (n / e)^n)."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        r = 1 / (n * n)
        far = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / n
        near = lgamma1p(n) - (n + 0.5) * np.log(n) + n - LN_SQRT_2PI
        return np.where(n > 15, far, near)


def deviance(x, m) -> np.ndarray:
    """x ln(x / m) + m - x, without cancellation where x is near m."""
    x, m = np.broadcast_arrays(np.asarray(x, float), np.asarray(m, float))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        d = (x - m) / (x + m)
        near = np.abs(d) < 0.1
        v = np.where(near, d, 0.0)
        s, p = (x - m) * v, 2 * x * v
        for j in range(1, 14):
            p = p * v * v
            s = s + p / (2 * j + 1)
        return np.where(near, s, np.where(x == 0, m, x * np.log(x / m) + m - x))


def ln_gamma_front(a, x) -> np.ndarray:
    """ln of x^a e^-x / Gamma(a + 1)."""
    a, x = np.asarray(a, float), np.asarray(x, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(a < 10, a * np.log(x) - x - lgamma1p(a), -stirling(a) - deviance(a, x) - 0.5 * np.log(2 * math.pi * a))


def _lentz(first, a_of, b_of, shape) -> np.ndarray:
    """first / (b1 + a2 / (b2 + ...)) by modified Lentz; a_of(k), b_of(k) give the terms."""
    f = np.full(shape, _TINY)
    c, d = f.copy(), np.zeros(shape)
    for k in range(1, _MOST):
        a, b = (first if k == 1 else a_of(k)), b_of(k)
        d = b + a * d
        c = b + a / c
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = c * d
        f = f * step
        if np.all(~(np.abs(step - 1) > _EPS)):
            break
    return f


def _gamma_parts(a, x) -> tuple[np.ndarray, np.ndarray]:
    """(ln P, ln Q) of the incomplete gamma functions, for a > 0 and 0 < x < inf."""
    ln_p, ln_q = np.empty(a.shape), np.empty(a.shape)
    tiny = (a < 1) & (x < 1.1)
    low = ~tiny & (x < a + 1)
    high = ~tiny & ~low
    if tiny.any():
        aa, xx = a[tiny], x[tiny]
        ln_head = aa * np.log(xx) - lgamma1p(aa)
        term, s = np.ones_like(xx), np.zeros_like(xx)
        for n in range(1, 40):
            term = term * -xx / n
            s = s + term / (aa + n)
        q = -np.expm1(ln_head) - np.exp(ln_head) * aa * s
        p = np.exp(ln_head) * (1 + aa * s)
        ln_p[tiny], ln_q[tiny] = np.where(p < 0.7, np.log(np.maximum(p, 5e-324)), np.log1p(-np.minimum(q, 1))), np.where(q < 0.7, np.log(np.maximum(q, 5e-324)), np.log1p(-np.minimum(p, 1)))
        under = p == 0
        ln_p[tiny] = np.where(under, ln_head, ln_p[tiny])
    if low.any():
        aa, xx = a[low], x[low]
        term, s = np.ones_like(xx), np.ones_like(xx)
        for n in range(1, _MOST):
            term = term * xx / (aa + n)
            s = s + term
            if np.all(term <= s * _EPS):
                break
        lp = ln_gamma_front(aa, xx) + np.log(s)
        ln_p[low], ln_q[low] = np.minimum(lp, 0), np.log1p(-np.exp(np.minimum(lp, -1e-17)))
    if high.any():
        aa, xx = a[high], x[high]
        f = _lentz(np.ones_like(aa), lambda k: -(k - 1) * (k - 1 - aa), lambda k: xx + 2 * k - 1 - aa, aa.shape)
        lq = ln_gamma_front(aa, xx) + np.log(aa) + np.log(f)
        ln_q[high], ln_p[high] = np.minimum(lq, 0), np.log1p(-np.exp(np.minimum(lq, -1e-17)))
    return ln_p, ln_q


def _incomplete_gamma(a, x, upper: bool, log: bool) -> np.ndarray:
    a, x = (v.astype(float) for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float)))
    out = np.full(a.shape, np.nan)
    ok = ~(np.isnan(a) | np.isnan(x))
    out[ok & ((x <= 0) | (a <= 0))] = 1.0 if upper else 0.0
    out[ok & (x == np.inf) & (a > 0)] = 0.0 if upper else 1.0
    go = ok & (a > 0) & (x > 0) & (x < np.inf)
    with np.errstate(all="ignore"):
        if log:
            out = np.log(out)
        if go.any():
            part = _gamma_parts(a[go], x[go])[1 if upper else 0]
            out[go] = part if log else np.exp(part)
    return out


def gammp(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma; 0 for x <= 0 or a <= 0."""
    return _incomplete_gamma(a, x, False, False)


def gammq(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma; 1 for x <= 0 or a <= 0."""
    return _incomplete_gamma(a, x, True, False)


def ln_gammp(a, x) -> np.ndarray:
    """ln gammp, below the range of doubles too."""
    return _incomplete_gamma(a, x, False, True)


def ln_gammq(a, x) -> np.ndarray:
    """ln gammq, below the range of doubles too."""
    return _incomplete_gamma(a, x, True, True)


def lbeta(a, b) -> np.ndarray:
    """ln B(a, b); differences of large ln Gamma are taken in Stirling form."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    with np.errstate(all="ignore"):
        n = lo + hi
        # ln Gamma(hi) - ln Gamma(n), by ln Gamma(z) = (z - 1/2) ln z - z + ln sqrt(2 pi) + stirling(z)
        far = lgamma(lo) + stirling(hi) - stirling(n) - lo * np.log(n) - (hi - 0.5) * np.log1p(lo / hi) + lo
        return np.where(np.isnan(n) | (lo < 0), np.nan, np.where(hi > 15, far, lgamma(lo) + lgamma(hi) - lgamma(n)))


def beta(a, b) -> np.ndarray:
    """exp(lbeta)."""
    return np.exp(lbeta(a, b))


def ln_beta_front(a, b, x, y) -> np.ndarray:
    """ln of x^a y^b / B(a, b), with y = 1 - x."""
    n = a + b
    with np.errstate(all="ignore"):
        core = stirling(n) - stirling(a) - stirling(b) - deviance(a, n * x) - deviance(b, n * y)
        saddle = core + 0.5 * np.log(a * b / (2 * math.pi * n))
        return np.where(np.minimum(a, b) < 3, a * np.log(x) + b * np.log(y) - lbeta(a, b), saddle)


def _beta_parts(a, b, x, y) -> tuple[np.ndarray, np.ndarray]:
    """(ln I, ln(1 - I)) for a, b > 0 and 0 < x < 1."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, y, x), np.where(flip, x, y)

    def top(k):  # k = 2, 3, ...: the even and odd coefficients of the classical fraction
        m = (k - 1) // 2
        if (k - 1) % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    f = _lentz(np.ones(x.shape), top, lambda k: 1.0, x.shape)
    ln_i = np.minimum(ln_beta_front(a, b, x, y) - np.log(a) + np.log(f), 0.0)
    rest = np.log1p(-np.exp(np.minimum(ln_i, -1e-17)))
    return np.where(flip, rest, ln_i), np.where(flip, ln_i, rest)


def _incomplete_beta(a, b, x, y, upper: bool, log: bool) -> np.ndarray:
    a, b, x, y = (v.astype(float) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, y))))
    out = np.full(a.shape, np.nan)
    ok = ~(np.isnan(a) | np.isnan(b) | np.isnan(x))
    out[ok & (x <= 0)] = 1.0 if upper else 0.0
    out[ok & (y <= 0)] = 0.0 if upper else 1.0
    go = ok & (x > 0) & (y > 0) & (a > 0) & (b > 0) & np.isfinite(a) & np.isfinite(b)
    with np.errstate(all="ignore"):
        if log:
            out = np.log(out)
        if go.any():
            part = _beta_parts(a[go], b[go], x[go], y[go])[1 if upper else 0]
            out[go] = part if log else np.exp(part)
    return out


def betai(a, b, x) -> np.ndarray:
    """Regularised incomplete beta; x is held to [0, 1]."""
    x = np.clip(np.asarray(x, float), 0, 1)
    return _incomplete_beta(a, b, x, 1 - x, False, False)


def betai_upper(a, b, x) -> np.ndarray:
    """1 - betai, with its own accuracy."""
    x = np.clip(np.asarray(x, float), 0, 1)
    return _incomplete_beta(a, b, x, 1 - x, True, False)


def ln_betai(a, b, x, y) -> np.ndarray:
    """ln betai, with y = 1 - x given."""
    return _incomplete_beta(a, b, x, y, False, True)


def digamma(x) -> np.ndarray:
    """The digamma function for x > 0; NaN elsewhere."""
    x = np.array(x, float)
    out = np.zeros(x.shape)
    with np.errstate(all="ignore"):
        bad = ~(x > 0)
        for _ in range(10):
            low = x < 10
            out = np.where(low, out - 1 / x, out)
            x = np.where(low, x + 1, x)
        r = 1 / (x * x)
        tail = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * 691 / 32760)))))
        out = out + np.log(x) - 0.5 / x - tail
    return np.where(bad, np.nan, out)


def logsumexp(xs) -> float:
    """ln sum exp of an array; -inf for an empty one, NaN where one is NaN."""
    x = np.asarray(xs, float)
    if not x.size:
        return -math.inf
    m = float(x.max())
    if not math.isfinite(m):
        return m
    return m + math.log(math.fsum(np.exp(x - m)))


def _norm_ppf(p: float) -> float:
    if math.isnan(p):
        return math.nan
    if p <= 0:
        return -math.inf
    if p >= 1:
        return math.inf
    x = NormalDist().inv_cdf(p)
    tail = 0.5 * math.erfc(-x / math.sqrt(2)) if x < 0 else 0.5 * math.erfc(x / math.sqrt(2))
    density = math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    if density > 0 and tail > 1e-290:
        u = (tail - p) / density if x < 0 else (1 - p - tail) / density
        x -= u / (1 + x * u / 2)
    return x


norm_ppf = _each(_norm_ppf)


def erfc_inv(p) -> np.ndarray:
    """The inverse of erfc on (0, 2); infinite at the ends, NaN beyond."""
    p = np.asarray(p, float)
    with np.errstate(invalid="ignore"):
        near_one = np.abs(1 - p) < 0.5
        return np.where((p < 0) | (p > 2), np.nan, np.where(near_one, erf_inv(np.where(near_one, 1 - p, 0)), -norm_ppf(p / 2) / math.sqrt(2)))


def _erf_inv(x: float) -> float:
    if math.isnan(x) or abs(x) > 1:
        return math.nan
    if abs(x) == 1:
        return math.copysign(math.inf, x)
    if abs(x) > 0.5:
        return math.copysign(-_norm_ppf((1 - abs(x)) / 2) / math.sqrt(2), x)
    y = x * math.sqrt(math.pi) / 2
    for _ in range(6):
        u = (math.erf(y) - x) * math.sqrt(math.pi) / 2 * math.exp(y * y)
        y -= u / (1 + y * u)
    return y


erf_inv = _each(_erf_inv)


def invert(f: Callable[[np.ndarray], np.ndarray], target, lo, hi, rising: bool = True) -> np.ndarray:
    """For each element, the float in [lo, hi] where monotone f comes closest to the target; lo and hi are not negative."""
    target, lo, hi = np.broadcast_arrays(np.asarray(target, float), np.asarray(lo, float), np.asarray(hi, float))
    a, b = lo.copy().view(np.int64), hi.copy().view(np.int64)
    for _ in range(65):
        mid = a + (b - a) // 2
        v = f(mid.view(float))
        up = (v < target) if rising else (v > target)
        a, b = np.where(up, mid, a), np.where(up, b, mid)
        if np.all(b - a <= 1):
            break
    x, y = a.view(float), b.view(float)
    with np.errstate(invalid="ignore"):
        return np.where(np.abs(f(x) - target) < np.abs(f(y) - target), x, y)


def _inverse_beta(a, b, p, upper: bool) -> np.ndarray:
    a, b, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, p)))
    p = np.clip(p, 0, 1)
    # solve for the smaller of x and 1 - x, so that both ends keep their accuracy
    middle = betai_upper(a, b, 0.5) if upper else betai(a, b, 0.5)
    left = p >= middle if upper else p <= middle
    own = lambda x: np.where(left, betai_upper(a, b, x) if upper else betai(a, b, x), betai(b, a, x) if upper else betai_upper(b, a, x))
    falling = left == upper
    out = np.where(falling, invert(own, p, 0.0, 0.5, False), invert(own, p, 0.0, 0.5, True))
    out = np.where(left, out, 1 - out)
    out = np.where(p == (1 if upper else 0), 0.0, np.where(p == (0 if upper else 1), 1.0, out))
    return np.where(np.isnan(a) | np.isnan(b) | np.isnan(p), np.nan, out)


def inv_beta_reg(a, b, p) -> np.ndarray:
    """x with betai(a, b, x) = p; p is held to [0, 1]."""
    return _inverse_beta(a, b, p, False)


def inv_beta_reg_upper(a, b, q) -> np.ndarray:
    """x with 1 - betai(a, b, x) = q."""
    return _inverse_beta(a, b, q, True)


def inv_gammp(a, p, upper: bool = False) -> np.ndarray:
    """x with gammp(a, x) = p, or gammq(a, x) = p."""
    a, p = np.broadcast_arrays(np.asarray(a, float), np.asarray(p, float))
    f = (lambda x: gammq(a, x)) if upper else (lambda x: gammp(a, x))
    x = invert(f, p, 0.0, np.maximum(1e3, 40 * (a + 40)), not upper)
    ends = (0.0, np.inf) if not upper else (np.inf, 0.0)
    return np.where(p <= 0, ends[0], np.where(p >= 1, ends[1], x))


def column(f: Callable, *args):
    """f over Columns or numbers, as an Arrow function: doubles in, doubles out; a null counts as NaN."""
    import pyarrow as pa
    from pyspark.sql import Column
    from pyspark.sql import functions as F

    def run(*arrays: pa.Array) -> pa.Array:
        got = f(*(a.to_numpy(zero_copy_only=False).astype(float) for a in arrays))
        return pa.array(np.asarray(got, float), pa.float64())

    n = len(args)
    # Arrow functions are told apart by their type hints, so each arity is spelled out
    if n == 1:
        def udf(a: pa.Array) -> pa.Array:
            return run(a)
    elif n == 2:
        def udf(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)
    elif n == 3:
        def udf(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run(a, b, c)
    else:
        def udf(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
            return run(a, b, c, d)
    udf.__annotations__ = {k: pa.Array for k in udf.__code__.co_varnames[:n]} | {"return": pa.Array}
    own = F.arrow_udf(udf, "double")
    return own(*((a if isinstance(a, Column) else F.lit(float(a))).cast("double") for a in args))
