"""One-sided Clopper-Pearson bound (E14), on aggregated rows. The binomial distribution function is a regularised incomplete
beta function, whose continued fraction takes a number of terms that does not grow with the errors but, near the mean, with the
root of n: no list of errors is ever laid out."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType

_TINY = 1e-300


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.tolist()), float, len(x))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, most: int = 400_000) -> np.ndarray:
    """The continued fraction of the incomplete beta function (modified Lentz), for ``x < (a + 1) / (a + b + 2)``."""
    c = np.ones(len(a))
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    out, live = d.copy(), np.arange(len(a))
    a, b, x = a.copy(), b.copy(), x.copy()
    for m in range(1, most if len(a) else 0):
        two = 2 * m
        for term in (m * (b - m) * x / ((a + two - 1) * (a + two)), -(a + m) * (a + b + m) * x / ((a + two) * (a + two + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            out[live] *= step
        go = np.abs(step - 1) > 1e-14
        if not go.all():
            live, a, b, x, c, d = live[go], a[go], b[go], x[go], c[go], d[go]
            if not len(live):
                break
    return out


def cdf(errors: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= errors) of a binomial(n, p), for ``0 <= errors < n`` and ``0 < p < 1``: ``I(1 - p; n - errors, errors + 1)``."""
    a, b, x = n - errors, errors + 1.0, 1 - p
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log1p(-p) + b * np.log(p))
    left = x < (a + 1) / (a + b + 2)
    out = np.empty(len(a))
    out[left] = (front / a)[left] * _fraction(a[left], b[left], x[left])
    out[~left] = 1 - (front / b)[~left] * _fraction(b[~left], a[~left], p[~left])
    return out


def upper_bounds(errors: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """The largest error rates that ``errors`` of ``n`` do not contradict at level ``alpha``: 1 for n <= 0 or errors >= n, closed
    form for no error, else the p where the distribution function is ``alpha`` (Newton steps kept inside a bracket)."""
    errors, n = np.asarray(errors, float), np.asarray(n, float)
    out = np.ones(len(n))
    none = (errors <= 0) & (n > 0)
    out[none] = 1 - alpha ** (1 / n[none])
    at = np.flatnonzero((errors > 0) & (errors < n))
    e, m = errors[at], n[at]
    lo, hi = e / m, np.ones(len(at))
    p = np.minimum(lo + 1.645 * np.sqrt(lo * (1 - lo) / m) + 1 / m, (lo + 1) / 2)
    for _ in range(100):
        if not len(at):
            break
        f = cdf(e, m, p) - alpha
        lo, hi = np.where(f > 0, p, lo), np.where(f > 0, hi, p)
        slope = -np.exp(_log_gamma(m + 1) - _log_gamma(e + 1) - _log_gamma(m - e) + e * np.log(p) + (m - e - 1) * np.log1p(-p))
        new = p - f / np.where(slope == 0, -_TINY, slope)
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        done = np.abs(new - p) <= 1e-12 * p
        out[at] = p = new
        if done.any():
            at, e, m, lo, hi, p = (x[~done] for x in (at, e, m, lo, hi, p))
    return out


def upper_bound(errors: int, n: int, alpha: float = 0.05) -> float:
    return float(upper_bounds(np.array([errors]), np.array([n]), alpha)[0])


@pandas_udf(DoubleType())
def error_bound(errors: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(upper_bounds(errors.fillna(0).to_numpy(), n.fillna(0).to_numpy()))


def bound_is_at_most(errors, n, most: float, alpha: float = 0.05):
    """Whether the bound of (errors, n) is ``most`` or less: one value of the distribution function instead of a search."""

    @pandas_udf(BooleanType())
    def passes(errors: pd.Series, n: pd.Series) -> pd.Series:
        e, m = errors.to_numpy(float), n.to_numpy(float)
        some = (e >= 0) & (e < m)
        out = np.zeros(len(m), bool)
        out[some] = cdf(e[some], m[some], np.full(some.sum(), most)) <= alpha
        return pd.Series(out)

    return passes(errors, n)
