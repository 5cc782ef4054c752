"""Probability distributions. Each is a frozen dataclass; its methods take Columns or numbers and return Columns, and the same functions over
numpy arrays are in ``.numpy``.

Continuous: cdf, sf, quantile, isf, density, log_density. Discrete: cdf, sf, quantile, mass, log_mass. All: mean, variance, std_dev,
skewness, kurtosis, entropy (None where undefined), support. NaN (or null) in gives NaN; probabilities outside [0, 1] give NaN, as does the
upper end of an unbounded discrete support. Where Spark has the functions, the Columns are native expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np

from quillon.functions import special as S

_SQRT2 = math.sqrt(2)


def _phi(z) -> np.ndarray:
    return 0.5 * S.erfc(-np.asarray(z, float) / _SQRT2)


class _Numpy:
    """The array functions of a distribution, with the contract for ends and NaN around the raw ones."""

    def __init__(self, dist: Distribution) -> None:
        self.d = dist

    def _ends(self, x, raw, below: float, above: float):
        x = np.asarray(x, float)
        lo, hi = self.d.support()
        with np.errstate(all="ignore"):
            inside = np.clip(x, lo if math.isfinite(lo) else -np.finfo(float).max, hi if math.isfinite(hi) else np.finfo(float).max)
            return np.where(np.isnan(x), np.nan, np.where(x < lo, below, np.where((x > hi) | (x == np.inf), above, np.where(x == -np.inf, below, raw(inside)))))

    def cdf(self, x):
        return self._ends(x, lambda v: np.clip(self.d._cdf(v), 0, 1), 0.0, 1.0)

    def sf(self, x):
        return self._ends(x, lambda v: np.clip(self.d._sf(v), 0, 1), 1.0, 0.0)

    def density(self, x):
        return self._ends(x, lambda v: np.exp(self.d._ln(v)), 0.0, 0.0)

    def log_density(self, x):
        return self._ends(x, self.d._ln, -np.inf, -np.inf)

    def mass(self, k):
        k = np.asarray(k, float)
        return np.where(k == np.floor(k), self.density(k), np.where(np.isnan(k), np.nan, 0.0))

    def log_mass(self, k):
        k = np.asarray(k, float)
        return np.where(k == np.floor(k), self.log_density(k), np.where(np.isnan(k), np.nan, -np.inf))

    def _probability(self, p, raw, at0: float, at1: float):
        p = np.asarray(p, float)
        with np.errstate(all="ignore"):
            inside = np.clip(p, 5e-324, 1 - 2**-53)
            return np.where(np.isnan(p) | (p < 0) | (p > 1), np.nan, np.where(p == 0, at0, np.where(p == 1, at1, raw(inside))))

    def quantile(self, p):
        lo, hi = self.d.support()
        if self.d.discrete:
            return self._probability(p, self.d._quantile, lo, math.nan if math.isinf(hi) else hi)
        # 1 - p is exact from 1/2 up, so the nearer tail is inverted
        return self._probability(p, lambda v: np.where(v > 0.5, self.d._isf(np.where(v > 0.5, 1 - v, 0.5)), self.d._quantile(np.minimum(v, 0.5))), lo, hi)

    def isf(self, q):
        lo, hi = self.d.support()
        return self._probability(q, lambda v: np.where(v > 0.5, self.d._quantile(np.where(v > 0.5, 1 - v, 0.5)), self.d._isf(np.minimum(v, 0.5))), hi, lo)


class Distribution:
    """Common surface."""

    discrete = False

    @property
    def numpy(self) -> _Numpy:
        return _Numpy(self)

    def _column(self, name: str, x):
        return S.column(getattr(self.numpy, name), x)

    def cdf(self, x):
        """P(X <= x)."""
        return self._column("cdf", x)

    def sf(self, x):
        """P(X > x), from the upper tail itself."""
        return self._column("sf", x)

    def quantile(self, p):
        """The least x with cdf(x) >= p."""
        return self._column("quantile", p)

    def std_dev(self) -> float | None:
        """Square root of the variance."""
        v = self.variance()
        return None if v is None else math.sqrt(v)

    def _sample(self, u) -> np.ndarray:
        """Values from uniform numbers in (0, 1), by the inverse cdf."""
        return self.numpy.quantile(u)

    def sample(self, spark, n: int, seed: int, partitions: int = 8):
        """(draw, value) of n draws; draw i depends on the seed and i alone."""
        from quillon.operators import rng

        return rng.sampled(spark, self._sample, n, seed, partitions)

    # moments that aren't overridden are undefined
    def mean(self) -> float | None:
        return None

    def variance(self) -> float | None:
        return None

    def skewness(self) -> float | None:
        return None

    def kurtosis(self) -> float | None:
        return None

    def entropy(self) -> float | None:
        return None

    def _require(self, ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"{type(self).__name__}: {what}")

    def _finite(self, *positive: str) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            self._require(not math.isnan(v) and (not math.isinf(v)), f"{f.name} must be finite")
            self._require(f.name not in positive or v > 0, f"{f.name} must be positive")


class Continuous(Distribution):
    """Adds isf, density and log_density."""

    def isf(self, q):
        """x with sf(x) = q."""
        return self._column("isf", q)

    def density(self, x):
        """The density."""
        return self._column("density", x)

    def log_density(self, x):
        """ln of the density."""
        return self._column("log_density", x)

    def support(self) -> tuple[float, float]:
        return -math.inf, math.inf

    def _isf(self, q):
        lo, hi = self.support()
        if lo >= 0:
            return S.invert(self._sf, q, lo, min(hi, 1e300), False)
        raise NotImplementedError

    def _quantile(self, p):
        lo, hi = self.support()
        if lo >= 0:
            return S.invert(self._cdf, p, lo, min(hi, 1e300), True)
        raise NotImplementedError


class Discrete(Distribution):
    """Adds mass and log_mass; quantiles by bisection over the integers."""

    discrete = True

    def mass(self, k):
        """P(X = k)."""
        return self._column("mass", k)

    def log_mass(self, k):
        """ln P(X = k)."""
        return self._column("log_mass", k)

    def _quantile(self, p):
        lo, hi = self.support()
        p = np.asarray(p, float)
        a = np.full(p.shape, float(lo) - 1)
        b = np.full(p.shape, float(hi) if math.isfinite(hi) else 2.0**53)
        for _ in range(64):
            mid = np.floor((a + b) / 2)
            enough = self.numpy.cdf(mid) >= p
            a, b = np.where(enough, a, mid), np.where(enough, mid, b)
            if np.all(b - a <= 1):
                break
        return b

    def _isf(self, q):
        raise NotImplementedError


def _native(x):
    from pyspark.sql import Column
    from pyspark.sql import functions as F

    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


@dataclass(frozen=True)
class Normal(Continuous):
    mean_: float = 0.0
    sd: float = 1.0

    def __post_init__(self):
        self._finite("sd")

    def _z(self, x):
        return (x - self.mean_) / self.sd

    def _cdf(self, x):
        return _phi(self._z(x))

    def _sf(self, x):
        return _phi(-self._z(x))

    def _ln(self, x):
        return -0.5 * self._z(x) ** 2 - math.log(self.sd) - S.LN_SQRT_2PI

    def _quantile(self, p):
        return self.mean_ + self.sd * S.norm_ppf(p)

    def _isf(self, q):
        return self.mean_ - self.sd * S.norm_ppf(q)

    def density(self, x):
        from pyspark.sql import functions as F

        z = (_native(x) - self.mean_) / self.sd
        return F.exp(-0.5 * z * z) / (self.sd * math.sqrt(2 * math.pi))

    def mean(self):
        return self.mean_

    def variance(self):
        return self.sd**2

    def skewness(self):
        return 0.0

    def kurtosis(self):
        return 0.0

    def entropy(self):
        return 0.5 + S.LN_SQRT_2PI + math.log(self.sd)


@dataclass(frozen=True)
class StudentT(Continuous):
    df: float

    def __post_init__(self):
        self._finite("df")

    def _tail(self, x):  # P(T > |x|)
        x = np.abs(np.asarray(x, float))
        n = self.df
        big = x * x > n
        with np.errstate(all="ignore"):
            u = np.where(big, n / x / x / (1 + n / x / x), n / (n + x * x))
            v = np.where(big, 1 / (1 + n / x / x), x * x / (n + x * x))
        return 0.5 * np.where(big, S._incomplete_beta(n / 2, 0.5, u, v, False, False), S._incomplete_beta(0.5, n / 2, v, u, True, False))

    def _cdf(self, x):
        t = self._tail(x)
        return np.where(np.asarray(x) < 0, t, 1 - t)

    def _sf(self, x):
        t = self._tail(x)
        return np.where(np.asarray(x) > 0, t, 1 - t)

    def _ln(self, x):
        n = self.df
        return -float(S.lbeta(n / 2, 0.5)) - 0.5 * math.log(n) - (n + 1) / 2 * np.log1p(np.asarray(x) ** 2 / n)

    def _quantile(self, p):
        p = np.asarray(p, float)
        tail = np.minimum(p, 1 - p)
        x = S.invert(self._tail, tail, 0.0, 1e300, False)
        x = np.where(p == 0.5, 0.0, x)
        return np.where(p < 0.5, -x, x)

    def _isf(self, q):
        q = np.asarray(q, float)
        x = S.invert(self._tail, np.minimum(q, 1 - q), 0.0, 1e300, False)
        return np.where(q == 0.5, 0.0, np.where(q < 0.5, x, -x))

    def mean(self):
        return 0.0 if self.df > 1 else None

    def variance(self):
        return self.df / (self.df - 2) if self.df > 2 else math.inf if self.df > 1 else None

    def skewness(self):
        return 0.0 if self.df > 3 else None

    def kurtosis(self):
        return 6 / (self.df - 4) if self.df > 4 else math.inf if self.df > 2 else None

    def entropy(self):
        n = self.df
        return (n + 1) / 2 * float(S.digamma((n + 1) / 2) - S.digamma(n / 2)) + 0.5 * math.log(n) + float(S.lbeta(n / 2, 0.5))


@dataclass(frozen=True)
class Gamma(Continuous):
    shape: float
    rate: float = 1.0

    def __post_init__(self):
        self._finite("shape", "rate")

    def support(self):
        return 0.0, math.inf

    def _cdf(self, x):
        return S.gammp(self.shape, self.rate * np.asarray(x, float))

    def _sf(self, x):
        return S.gammq(self.shape, self.rate * np.asarray(x, float))

    def _ln(self, x):
        a, y = self.shape, self.rate * np.asarray(x, float)
        with np.errstate(all="ignore"):
            inner = S.ln_gamma_front(a, y) + math.log(a) - np.log(y) + math.log(self.rate)
        at0 = math.inf if a < 1 else math.log(self.rate) if a == 1 else -math.inf
        return np.where(y == 0, at0, inner)

    def _quantile(self, p):
        return S.inv_gammp(self.shape, p) / self.rate

    def _isf(self, q):
        return S.inv_gammp(self.shape, q, True) / self.rate

    def mean(self):
        return self.shape / self.rate

    def variance(self):
        return self.shape / self.rate**2

    def skewness(self):
        return 2 / math.sqrt(self.shape)

    def kurtosis(self):
        return 6 / self.shape

    def entropy(self):
        a = self.shape
        return a - math.log(self.rate) + math.lgamma(a) + (1 - a) * float(S.digamma(a))


@dataclass(frozen=True)
class ChiSquared(Gamma):
    """k degrees of freedom: Gamma(k / 2, rate 1 / 2)."""

    def __init__(self, k: float) -> None:
        object.__setattr__(self, "shape", k / 2)
        object.__setattr__(self, "rate", 0.5)
        self._finite("shape", "rate")


@dataclass(frozen=True)
class Beta(Continuous):
    alpha: float
    beta: float

    def __post_init__(self):
        self._finite("alpha", "beta")

    def support(self):
        return 0.0, 1.0

    def _cdf(self, x):
        return S.betai(self.alpha, self.beta, x)

    def _sf(self, x):
        return S.betai_upper(self.alpha, self.beta, x)

    def _ln(self, x):
        a, b, x = self.alpha, self.beta, np.asarray(x, float)
        with np.errstate(all="ignore"):
            inner = S.ln_beta_front(a, b, x, 1 - x) - np.log(x) - np.log1p(-x)
        end = lambda s, o: math.inf if s < 1 else math.log(o) if s == 1 else -math.inf
        return np.where(x == 0, end(a, b), np.where(x == 1, end(b, a), inner))

    def _quantile(self, p):
        return S.inv_beta_reg(self.alpha, self.beta, p)

    def _isf(self, q):
        return S.inv_beta_reg_upper(self.alpha, self.beta, q)

    def mean(self):
        return self.alpha / (self.alpha + self.beta)

    def variance(self):
        s = self.alpha + self.beta
        return self.alpha * self.beta / (s * s * (s + 1))

    def skewness(self):
        a, b = self.alpha, self.beta
        return 2 * (b - a) * math.sqrt(a + b + 1) / ((a + b + 2) * math.sqrt(a * b))

    def kurtosis(self):
        a, b = self.alpha, self.beta
        return 6 * ((a - b) ** 2 * (a + b + 1) - a * b * (a + b + 2)) / (a * b * (a + b + 2) * (a + b + 3))

    def entropy(self):
        a, b = self.alpha, self.beta
        return float(S.lbeta(a, b) - (a - 1) * S.digamma(a) - (b - 1) * S.digamma(b) + (a + b - 2) * S.digamma(a + b))


@dataclass(frozen=True)
class FisherF(Continuous):
    dfn: float
    dfd: float

    def __post_init__(self):
        self._finite("dfn", "dfd")

    def support(self):
        return 0.0, math.inf

    def _parts(self, x):
        m, n, x = self.dfn, self.dfd, np.asarray(x, float)
        with np.errstate(all="ignore"):
            r = m * x / n
            return np.where(np.isinf(r), 1.0, r / (1 + r)), 1 / (1 + r)

    def _cdf(self, x):
        u, v = self._parts(x)
        return S._incomplete_beta(self.dfn / 2, self.dfd / 2, u, v, False, False)

    def _sf(self, x):
        u, v = self._parts(x)
        return S._incomplete_beta(self.dfn / 2, self.dfd / 2, u, v, True, False)

    def _ln(self, x):
        m, n, x = self.dfn, self.dfd, np.asarray(x, float)
        u, v = self._parts(x)
        with np.errstate(all="ignore"):
            inner = S.ln_beta_front(m / 2, n / 2, u, v) - np.log(x)
        at0 = math.inf if m < 2 else 0.0 if m == 2 else -math.inf
        return np.where(x == 0, at0, inner)

    def mean(self):
        return self.dfd / (self.dfd - 2) if self.dfd > 2 else None

    def variance(self):
        m, n = self.dfn, self.dfd
        return 2 * n * n * (m + n - 2) / (m * (n - 2) ** 2 * (n - 4)) if n > 4 else None

    def skewness(self):
        m, n = self.dfn, self.dfd
        return (2 * m + n - 2) * math.sqrt(8 * (n - 4)) / ((n - 6) * math.sqrt(m * (m + n - 2))) if n > 6 else None

    def kurtosis(self):
        m, n = self.dfn, self.dfd
        return 12 * (m * (5 * n - 22) * (m + n - 2) + (n - 4) * (n - 2) ** 2) / (m * (n - 6) * (n - 8) * (m + n - 2)) if n > 8 else None

    def entropy(self):
        m, n = self.dfn / 2, self.dfd / 2
        return float(math.log(n / m) + S.lbeta(m, n) + (1 - m) * S.digamma(m) - (1 + n) * S.digamma(n) + (m + n) * S.digamma(m + n))


@dataclass(frozen=True)
class Uniform(Continuous):
    a: float = 0.0
    b: float = 1.0

    def __post_init__(self):
        self._finite()
        self._require(self.a < self.b, "a must be below b")

    def support(self):
        return self.a, self.b

    def _share(self, x, start):  # halves keep b - a from overflowing
        return np.abs(np.asarray(x) / 2 - start / 2) / (self.b / 2 - self.a / 2)

    def _cdf(self, x):
        return self._share(x, self.a)

    def _sf(self, x):
        return self._share(x, self.b)

    def _ln(self, x):
        return np.full(np.shape(x), -math.log(self.b / 2 - self.a / 2) - math.log(2))

    def _quantile(self, p):
        return self.a * (1 - p) + self.b * p

    def _isf(self, q):
        return self.b * (1 - q) + self.a * q

    def mean(self):
        return self.a / 2 + self.b / 2

    def variance(self):
        return (self.b - self.a) ** 2 / 12

    def skewness(self):
        return 0.0

    def kurtosis(self):
        return -1.2

    def entropy(self):
        return math.log(self.b / 2 - self.a / 2) + math.log(2)

    def cdf(self, x):
        from pyspark.sql import functions as F

        x = _native(x)
        return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x / 2 - self.a / 2) / (self.b / 2 - self.a / 2))))


@dataclass(frozen=True)
class Exponential(Continuous):
    rate: float = 1.0

    def __post_init__(self):
        self._finite("rate")

    def support(self):
        return 0.0, math.inf

    def _cdf(self, x):
        return -np.expm1(-self.rate * np.asarray(x))

    def _sf(self, x):
        return np.exp(-self.rate * np.asarray(x))

    def _ln(self, x):
        return math.log(self.rate) - self.rate * np.asarray(x)

    def _quantile(self, p):
        return -np.log1p(-p) / self.rate

    def _isf(self, q):
        return -np.log(q) / self.rate

    def mean(self):
        return 1 / self.rate

    def variance(self):
        return 1 / self.rate**2

    def skewness(self):
        return 2.0

    def kurtosis(self):
        return 6.0

    def entropy(self):
        return 1 - math.log(self.rate)

    def cdf(self, x):
        from pyspark.sql import functions as F

        x = _native(x)
        return F.when(F.isnan(x), x).when(x <= 0, 0.0).otherwise(-F.expm1(-self.rate * x))

    def sf(self, x):
        from pyspark.sql import functions as F

        x = _native(x)
        return F.when(F.isnan(x), x).when(x <= 0, 1.0).otherwise(F.exp(-self.rate * x))


@dataclass(frozen=True)
class Cauchy(Continuous):
    loc: float = 0.0
    scale: float = 1.0

    def __post_init__(self):
        self._finite("scale")

    def _sf(self, x):
        z = (np.asarray(x, float) - self.loc) / self.scale
        with np.errstate(all="ignore"):
            return np.where(z > 1, np.arctan(1 / z) / math.pi, 0.5 - np.arctan(z) / math.pi)

    def _cdf(self, x):
        return self._sf(2 * self.loc - np.asarray(x, float))

    def _ln(self, x):
        z = (np.asarray(x, float) - self.loc) / self.scale
        with np.errstate(all="ignore"):
            return -math.log(math.pi * self.scale) - np.where(np.abs(z) > 1e100, 2 * np.log(np.abs(z)), np.log1p(z * z))

    def _isf(self, q):
        q = np.asarray(q, float)
        return self.loc + self.scale * np.where(q < 0.25, 1 / np.tan(math.pi * q), np.tan(math.pi * (0.5 - q)))

    def _quantile(self, p):
        return 2 * self.loc - self._isf(np.asarray(p, float))

    def entropy(self):
        return math.log(4 * math.pi * self.scale)


@dataclass(frozen=True)
class Weibull(Continuous):
    shape: float
    scale: float = 1.0

    def __post_init__(self):
        self._finite("shape", "scale")

    def support(self):
        return 0.0, math.inf

    def _h(self, x):
        return (np.asarray(x, float) / self.scale) ** self.shape

    def _cdf(self, x):
        return -np.expm1(-self._h(x))

    def _sf(self, x):
        return np.exp(-self._h(x))

    def _ln(self, x):
        k, z = self.shape, np.asarray(x, float) / self.scale
        with np.errstate(all="ignore"):
            inner = math.log(k / self.scale) + (k - 1) * np.log(z) - z**k
        at0 = math.inf if k < 1 else -math.log(self.scale) if k == 1 else -math.inf
        return np.where(z == 0, at0, inner)

    def _quantile(self, p):
        return self.scale * (-np.log1p(-p)) ** (1 / self.shape)

    def _isf(self, q):
        return self.scale * (-np.log(q)) ** (1 / self.shape)

    def _raw(self, n):
        return self.scale**n * math.gamma(1 + n / self.shape)

    def mean(self):
        return self._raw(1)

    def variance(self):
        return self._raw(2) - self._raw(1) ** 2

    def skewness(self):
        m, s = self.mean(), self.std_dev()
        return (self._raw(3) - 3 * m * s * s - m**3) / s**3

    def kurtosis(self):
        m, v = self.mean(), self.variance()
        return (self._raw(4) - 4 * m * self._raw(3) + 6 * m * m * self._raw(2) - 3 * m**4) / v**2 - 3

    def entropy(self):
        return np.euler_gamma * (1 - 1 / self.shape) + math.log(self.scale / self.shape) + 1


@dataclass(frozen=True)
class LogNormal(Continuous):
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self):
        self._finite("sigma")

    def support(self):
        return 0.0, math.inf

    def _z(self, x):
        with np.errstate(all="ignore"):
            return (np.log(np.asarray(x, float)) - self.mu) / self.sigma

    def _cdf(self, x):
        return _phi(self._z(x))

    def _sf(self, x):
        return _phi(-self._z(x))

    def _ln(self, x):
        x = np.asarray(x, float)
        with np.errstate(all="ignore"):
            return np.where(x == 0, -np.inf, -0.5 * self._z(x) ** 2 - np.log(x) - math.log(self.sigma) - S.LN_SQRT_2PI)

    def _quantile(self, p):
        return np.exp(self.mu + self.sigma * S.norm_ppf(p))

    def _isf(self, q):
        return np.exp(self.mu - self.sigma * S.norm_ppf(q))

    def mean(self):
        return math.exp(self.mu + self.sigma**2 / 2)

    def variance(self):
        return math.expm1(self.sigma**2) * math.exp(2 * self.mu + self.sigma**2)

    def skewness(self):
        return (math.exp(self.sigma**2) + 2) * math.sqrt(math.expm1(self.sigma**2))

    def kurtosis(self):
        w = math.exp(self.sigma**2)
        return w**4 + 2 * w**3 + 3 * w**2 - 6

    def entropy(self):
        return self.mu + 0.5 + S.LN_SQRT_2PI + math.log(self.sigma)


@dataclass(frozen=True)
class InverseGaussian(Continuous):
    mean_: float
    shape: float

    def __post_init__(self):
        self._finite("mean_", "shape")

    def support(self):
        return 0.0, math.inf

    def _terms(self, x):
        x = np.asarray(x, float)
        with np.errstate(all="ignore"):
            r = np.sqrt(self.shape / x)
            z, w = r * (x / self.mean_ - 1), r * (x / self.mean_ + 1)
            # exp(2 l / mu) Phi(-w), by the scaled function: 2 l / mu - w^2 / 2 = -z^2 / 2
            second = 0.5 * S.erfcx(w / _SQRT2) * np.exp(-z * z / 2)
        return z, second

    def _cdf(self, x):
        z, second = self._terms(x)
        return np.where(np.asarray(x) == 0, 0.0, _phi(z) + second)

    def _sf(self, x):
        z, second = self._terms(x)
        with np.errstate(all="ignore"):
            upper = np.where(z > 0, 0.5 * np.exp(-z * z / 2) * S.erfcx(z / _SQRT2), _phi(-z))
        return np.where(np.asarray(x) == 0, 1.0, upper - second)

    def _ln(self, x):
        x = np.asarray(x, float)
        with np.errstate(all="ignore"):
            inner = 0.5 * math.log(self.shape / (2 * math.pi)) - 1.5 * np.log(x) - self.shape * (x - self.mean_) ** 2 / (2 * self.mean_**2 * x)
        return np.where(x == 0, -np.inf, inner)

    def mean(self):
        return self.mean_

    def variance(self):
        return self.mean_**3 / self.shape

    def skewness(self):
        return 3 * math.sqrt(self.mean_ / self.shape)

    def kurtosis(self):
        return 15 * self.mean_ / self.shape

    def entropy(self):
        return None


@dataclass(frozen=True)
class StudentizedRange(Continuous):
    """The range of k normal values over an independent standard deviation of df degrees of freedom; df may be infinite.

    Both integrals are taken by Gauss-Legendre rules: the inner over the place of the least value, the outer over ln of the deviation.
    """

    k: float
    df: float

    def __post_init__(self):
        self._require(1 < self.k <= 1e6, "k must lie in (1, 1e6]")
        self._require(self.df > 0, "df must be positive")

    def support(self):
        return 0.0, math.inf

    @staticmethod
    def _rule(lo: float, hi: float, panels: int, nodes: int = 32):
        x, w = np.polynomial.legendre.leggauss(nodes)
        edges = np.linspace(lo, hi, panels + 1)
        h = np.diff(edges) / 2
        return (edges[:-1, None] + h[:, None] * (1 + x)).ravel(), (h[:, None] * w).ravel()

    def _range(self, q, what: str):
        """cdf, sf or density of the range of k standard normal values."""
        q = np.atleast_1d(np.asarray(q, float))
        z, w = self._rule(-9.0, 9.0, 10)
        # z is the greatest value: k phi(z) [Phi(z) - Phi(z - q)]^(k - 1)
        phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        out = np.empty(q.shape)
        top = _phi(z)
        for i, v in enumerate(q.ravel()):
            low = _phi(z - v)
            d = np.maximum(top - low, 0)
            if what == "cdf":
                f = self.k * phi * d ** (self.k - 1)
            elif what == "sf":
                with np.errstate(all="ignore"):
                    f = self.k * phi * top ** (self.k - 1) * -np.expm1((self.k - 1) * np.log1p(-np.minimum(low / top, 1)))
            else:
                f = self.k * (self.k - 1) * phi * d ** max(self.k - 2, 0) * np.exp(-((z - v) ** 2) / 2) / math.sqrt(2 * math.pi)
            out.ravel()[i] = (w * f).sum()
        return out

    def _mixed(self, q, what: str):
        q = np.asarray(q, float)
        if math.isinf(self.df):
            return self._range(q, what).reshape(q.shape)
        # s = deviation; its ln density is that of sqrt(chi2 / df)
        n = self.df
        wide = max(6.0 / math.sqrt(2 * n), 1e-6) * 3
        t, w = self._rule(-min(wide, 40 / n + wide), wide if n > 3 else wide + 2, 12 if n > 10 else 24)
        ln = math.log(2) + n / 2 * math.log(n / 2) - math.lgamma(n / 2) + n * t - n / 2 * np.exp(2 * t)
        p, s = w * np.exp(ln), np.exp(t)
        keep = p > 1e-22
        p, s = p[keep], s[keep]
        flat = q.ravel()
        vals = self._range(flat[:, None] * s, what).reshape(len(flat), len(s))
        return ((vals * s if what == "density" else vals) @ p).reshape(q.shape)

    def _cdf(self, x):
        return self._mixed(x, "cdf")

    def _sf(self, x):
        return self._mixed(x, "sf")

    def _ln(self, x):
        with np.errstate(all="ignore"):
            return np.log(self._mixed(x, "density"))

    def _quantile(self, p):
        return self._solve(p, self._cdf, True)

    def _isf(self, q):
        return self._solve(q, self._sf, False)

    def _solve(self, p, f, rising):
        p = np.asarray(p, float)
        lo, hi = np.zeros(p.shape), np.full(p.shape, 1.0)
        for _ in range(60):
            short = (f(hi) < p) if rising else (f(hi) > p)
            if not short.any():
                break
            hi = np.where(short, hi * 2, hi)
        for _ in range(52):
            mid = (lo + hi) / 2
            up = (f(mid) < p) if rising else (f(mid) > p)
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        return (lo + hi) / 2


@dataclass(frozen=True)
class Bernoulli(Discrete):
    p: float

    def __post_init__(self):
        self._require(0 <= self.p <= 1, "p must lie in [0, 1]")

    def support(self):
        return 0, 1

    def _cdf(self, k):
        return np.where(np.floor(k) >= 1, 1.0, 1 - self.p)

    def _sf(self, k):
        return np.where(np.floor(k) >= 1, 0.0, self.p)

    def _ln(self, k):
        with np.errstate(divide="ignore"):
            return np.where(np.asarray(k) == 1, np.log(self.p), np.log1p(-self.p))

    def mass(self, k):
        from pyspark.sql import functions as F

        k = _native(k)
        return F.when(F.isnan(k), k).when(k == 1, self.p).when(k == 0, 1 - self.p).otherwise(0.0)

    def mean(self):
        return self.p

    def variance(self):
        return self.p * (1 - self.p)

    def skewness(self):
        v = self.variance()
        return (1 - 2 * self.p) / math.sqrt(v) if v else None

    def kurtosis(self):
        v = self.variance()
        return (1 - 6 * v) / v if v else None

    def entropy(self):
        return -sum(x * math.log(x) for x in (self.p, 1 - self.p) if x > 0)


@dataclass(frozen=True)
class Binomial(Discrete):
    n: int
    p: float

    def __post_init__(self):
        self._require(self.n >= 0 and self.n == int(self.n) and 0 <= self.p <= 1, "n must be a count and p lie in [0, 1]")

    def support(self):
        return 0, self.n

    def _cdf(self, k):
        k = np.floor(np.asarray(k, float))
        return np.where(k >= self.n, 1.0, S._incomplete_beta(np.maximum(self.n - k, 0.5), k + 1, 1 - self.p, self.p, False, False))

    def _sf(self, k):
        k = np.floor(np.asarray(k, float))
        return np.where(k >= self.n, 0.0, S._incomplete_beta(k + 1, np.maximum(self.n - k, 0.5), self.p, 1 - self.p, False, False))

    def _ln(self, k):
        k, n, p = np.asarray(k, float), self.n, self.p
        with np.errstate(all="ignore"):
            core = S.stirling(n) - S.stirling(k) - S.stirling(n - k) - S.deviance(k, n * p) - S.deviance(n - k, n * (1 - p)) + 0.5 * np.log(n / (2 * math.pi * k * (n - k)))
            ends = np.where(k == 0, n * np.log1p(-p), n * np.log(p)) if n else np.zeros(k.shape)
            if p in (0.0, 1.0):
                return np.where(k == n * p, 0.0, -np.inf)
        return np.where((k == 0) | (k == n), ends, core)

    def mean(self):
        return self.n * self.p

    def variance(self):
        return self.n * self.p * (1 - self.p)

    def skewness(self):
        v = self.variance()
        return (1 - 2 * self.p) / math.sqrt(v) if v else None

    def kurtosis(self):
        v = self.variance()
        return (1 - 6 * self.p * (1 - self.p)) / v if v else None

    def entropy(self):
        m = self.numpy.mass(np.arange(self.n + 1))
        return float(-(m[m > 0] * np.log(m[m > 0])).sum())


@dataclass(frozen=True)
class Poisson(Discrete):
    rate: float

    def __post_init__(self):
        self._finite("rate")

    def support(self):
        return 0, math.inf

    def _cdf(self, k):
        return S.gammq(np.floor(np.asarray(k, float)) + 1, self.rate)

    def _sf(self, k):
        return S.gammp(np.floor(np.asarray(k, float)) + 1, self.rate)

    def _ln(self, k):
        k = np.asarray(k, float)
        return np.where(k == 0, -self.rate, S.ln_gamma_front(np.maximum(k, 1e-300), self.rate))

    def mean(self):
        return self.rate

    def variance(self):
        return self.rate

    def skewness(self):
        return 1 / math.sqrt(self.rate)

    def kurtosis(self):
        return 1 / self.rate

    def entropy(self):
        hi = int(self.rate + 40 * math.sqrt(self.rate) + 60)
        m = self.numpy.mass(np.arange(hi))
        return float(-(m[m > 0] * np.log(m[m > 0])).sum())


@dataclass(frozen=True)
class Geometric(Discrete):
    """Trials up to the first success: the support starts at 1."""

    p: float

    def __post_init__(self):
        self._require(0 < self.p <= 1, "p must lie in (0, 1]")

    def support(self):
        return 1, math.inf

    def _cdf(self, k):
        with np.errstate(all="ignore"):
            return -np.expm1(np.floor(k) * np.log1p(-self.p)) if self.p < 1 else np.ones(np.shape(k))

    def _sf(self, k):
        with np.errstate(all="ignore"):
            return np.exp(np.floor(k) * np.log1p(-self.p)) if self.p < 1 else np.zeros(np.shape(k))

    def _ln(self, k):
        k = np.asarray(k, float)
        if self.p == 1:
            return np.where(k == 1, 0.0, -np.inf)
        return math.log(self.p) + (k - 1) * math.log1p(-self.p)

    def mass(self, k):
        from pyspark.sql import functions as F

        k = _native(k)
        return F.when(F.isnan(k), k).when((k >= 1) & (k == F.floor(k)), self.p * F.pow(F.lit(1 - self.p), k - 1)).otherwise(0.0)

    def mean(self):
        return 1 / self.p

    def variance(self):
        return (1 - self.p) / self.p**2

    def skewness(self):
        return (2 - self.p) / math.sqrt(1 - self.p) if self.p < 1 else None

    def kurtosis(self):
        return 6 + self.p**2 / (1 - self.p) if self.p < 1 else None

    def entropy(self):
        p = self.p
        return (-(1 - p) * math.log1p(-p) - p * math.log(p)) / p if p < 1 else 0.0


@dataclass(frozen=True)
class NegBinomial(Discrete):
    """mass(k) = C(k + r - 1, k) (1 - p)^r p^k."""

    r: float
    p: float

    def __post_init__(self):
        self._require(self.r > 0 and math.isfinite(self.r) and 0 <= self.p < 1, "r must be positive and p lie in [0, 1)")

    @classmethod
    def from_mean_size(cls, mu: float, size: float) -> NegBinomial:
        return cls(size, mu / (mu + size))

    def support(self):
        return 0, math.inf

    def _cdf(self, k):
        return S._incomplete_beta(self.r, np.floor(np.asarray(k, float)) + 1, 1 - self.p, self.p, False, False)

    def _sf(self, k):
        return S._incomplete_beta(self.r, np.floor(np.asarray(k, float)) + 1, 1 - self.p, self.p, True, False)

    def _ln(self, k):
        k = np.asarray(k, float)
        with np.errstate(all="ignore"):
            # C(k + r - 1, k) = 1 / (k B(r, k)); the front has B(r, k), so only k is divided out
            inner = S.ln_beta_front(self.r, np.maximum(k, 1e-300), 1 - self.p, self.p) - np.log(k)
        return np.where(k == 0, self.r * math.log1p(-self.p), inner)

    def mean(self):
        return self.r * self.p / (1 - self.p)

    def variance(self):
        return self.r * self.p / (1 - self.p) ** 2

    def skewness(self):
        return (1 + self.p) / math.sqrt(self.r * self.p) if self.p else None

    def kurtosis(self):
        return 6 / self.r + (1 - self.p) ** 2 / (self.r * self.p) if self.p else None

    def entropy(self):
        hi = int(self.mean() + 60 * (self.std_dev() or 1) + 100)
        m = self.numpy.mass(np.arange(hi))
        return float(-(m[m > 0] * np.log(m[m > 0])).sum())


@dataclass(frozen=True)
class Hypergeometric(Discrete):
    """Successes in n draws from N with K successes."""

    N: int
    K: int
    n: int

    def __post_init__(self):
        self._require(all(v == int(v) and v >= 0 for v in (self.N, self.K, self.n)) and self.K <= self.N and self.n <= self.N, "counts with K <= N and n <= N")

    def support(self):
        return max(0, self.n + self.K - self.N), min(self.n, self.K)

    def _ln(self, k):
        k = np.asarray(k, float)
        c = lambda a, b: -np.log(a + 1.0) - S.lbeta(b + 1.0, a - b + 1.0)
        return c(self.K, k) + c(self.N - self.K, self.n - k) - c(self.N, float(self.n))

    def _sums(self, upper: bool):
        lo, hi = self.support()
        m = np.exp(self._ln(np.arange(lo, hi + 1)))
        return lo, (np.append(np.cumsum(m[::-1])[::-1][1:], 0.0) if upper else np.cumsum(m))

    def _cdf(self, k):
        lo, c = self._sums(False)
        return c[np.clip(np.floor(k) - lo, 0, len(c) - 1).astype(int)]

    def _sf(self, k):
        lo, c = self._sums(True)
        return c[np.clip(np.floor(k) - lo, 0, len(c) - 1).astype(int)]

    def mean(self):
        return self.n * self.K / self.N if self.N else None

    def variance(self):
        N, K, n = self.N, self.K, self.n
        return n * K * (N - K) * (N - n) / (N * N * (N - 1)) if N > 1 else None

    def _central(self, power: int):
        lo, hi = self.support()
        k = np.arange(lo, hi + 1)
        return float((np.exp(self._ln(k)) * (k - self.mean()) ** power).sum())

    def skewness(self):
        v = self.variance()
        return self._central(3) / v**1.5 if v else None

    def kurtosis(self):
        v = self.variance()
        return self._central(4) / v**2 - 3 if v else None

    def entropy(self):
        lo, hi = self.support()
        m = np.exp(self._ln(np.arange(lo, hi + 1)))
        return float(-(m[m > 0] * np.log(m[m > 0])).sum())


#: All families, continuous and discrete.
CONTINUOUS = (Normal, StudentT, ChiSquared, FisherF, Uniform, Exponential, Cauchy, Weibull, LogNormal, Gamma, Beta, InverseGaussian, StudentizedRange)
DISCRETE = (Bernoulli, Binomial, Poisson, Geometric, NegBinomial, Hypergeometric)
