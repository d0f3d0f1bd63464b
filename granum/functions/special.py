"""Special functions for tail probabilities, in plain Python on finished statistics."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Simpson integration after a substitution.

    With ``x = sin(t)^2`` the integrand is ``2 sin(t)^(2a-1) cos(t)^(2b-1)``, smooth for
    ``a, b >= 1/2``, which covers Student's t, F and binomial tails.
    """
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)

    def f(t: float) -> float:
        s, c = math.sin(t), math.cos(t)
        if s <= 0:
            return 0.0 if a > 0.5 else 2 * math.exp(norm)
        if c <= 0:
            return 0.0 if b > 0.5 else 2 * math.exp(norm)
        return 2 * math.exp(norm + (2 * a - 1) * math.log(s) + (2 * b - 1) * math.log(c))

    top, n = math.asin(math.sqrt(x)), 4000
    h = top / n
    total = f(0.0) + f(top) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n))
    return min(1.0, max(0.0, total * h / 3))


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return 1.0 - beta_inc(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2))


def t_quantile(p: float, df: float) -> float:
    """The t with two-sided tail ``1 - p``, by bisection."""
    lo, hi = 0.0, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def normal_cdf(z: float) -> float:
    """The standard normal distribution function."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of chi-squared: one less the lower incomplete gamma series, or its continued fraction."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    lead = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = 0
        while term > total * 1e-15:
            n += 1
            term *= y / (a + n)
            total += term
        return max(0.0, 1 - lead * total)
    tiny, b = 1e-300, y + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


_PHI = np.vectorize(normal_cdf, otypes=[float])
_Z = np.linspace(-8, 8, 641)
_DENSITY = np.exp(-_Z * _Z / 2) / math.sqrt(2 * math.pi)


def range_upper(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range of ``k`` means with ``df`` degrees of freedom.

    The range's distribution for a known deviation is integrated over the normal, then
    over the deviation's density, both on fixed grids.
    """
    if q <= 0:
        return 1.0
    wide = 9 / math.sqrt(2 * df)
    s = np.linspace(max(1e-6, 1 - wide), 1 + 1.5 * wide, 121) if df < 1e5 else np.array([1.0])
    lower = _PHI(_Z)[None, :]
    shifted = np.interp(_Z[None, :] - q * s[:, None], _FINE, _FINE_PHI)
    inner = k * np.trapezoid(_DENSITY * np.maximum(lower - shifted, 0) ** (k - 1), _Z, axis=1)
    if len(s) == 1:
        return float(min(1.0, max(0.0, 1 - inner[0])))
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    weight = np.exp(log)
    return float(min(1.0, max(0.0, 1 - np.trapezoid(inner * weight, s) / np.trapezoid(weight, s))))


_FINE = np.linspace(-40, 8, 48_001)
_FINE_PHI = np.vectorize(normal_cdf, otypes=[float])(_FINE)


def range_quantile(p: float, k: int, df: float) -> float:
    """The studentised range with upper tail ``1 - p``, by bisection."""
    lo, hi = 0.0, 200.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if range_upper(mid, k, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2


# MacKinnon's response surface for the unit-root t statistic with a constant.
ADF_LEAST, ADF_MOST, ADF_TURN = -18.83, 2.74, -1.61
ADF_SMALL, ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p(stat: float) -> float:
    """Approximate p-value of a Dickey-Fuller statistic with a constant."""
    if stat > ADF_MOST or stat < ADF_LEAST:
        return 1.0 if stat > ADF_MOST else 0.0
    return normal_cdf(sum(c * stat**i for i, c in enumerate(ADF_SMALL if stat <= ADF_TURN else ADF_LARGE)))
