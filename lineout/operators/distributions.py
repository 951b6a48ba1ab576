"""Tail probabilities for the few rows of a test table (SciPy is not assumed)."""

from __future__ import annotations

import math
from functools import cache

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_share(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def t_quantile(p: float, df: float) -> float:
    """Upper-half quantile of Student's t, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if 1.0 - beta_share(df / 2.0, 0.5, df / (df + mid * mid)) / 2.0 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    flat = np.array([math.erf(v / math.sqrt(2.0)) for v in x.ravel()])
    return (0.5 * (1.0 + flat)).reshape(x.shape)


def _range_cdf(width: float, groups: int) -> float:
    """P(range of ``groups`` standard normals <= width)."""
    z = 8.5 * _NODES
    density = np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
    inside = np.clip(_normal_cdf(z + width) - _normal_cdf(z), 0.0, 1.0)
    return min(1.0, float(groups * 8.5 * np.sum(_WEIGHTS * density * inside ** (groups - 1))))


def tukey_upper(q: float, groups: int, df: float) -> float:
    """P(studentised range > q), averaging over the scale estimate."""
    if q <= 0:
        return 1.0
    spread = 8.0 / math.sqrt(2.0 * df)
    low, high = max(1e-6, 1.0 - spread), 1.0 + spread
    nodes, weights = np.polynomial.legendre.leggauss(48)
    s = (high - low) / 2 * nodes + (high + low) / 2
    log_density = (
        math.log(2.0) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    )
    mass = np.exp(log_density) * weights * (high - low) / 2
    inner = np.array([_range_cdf(q * v, groups) for v in s])
    return float(min(1.0, max(0.0, 1.0 - np.sum(mass * inner) / np.sum(mass))))


def tukey_quantile(p: float, groups: int, df: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(45):
        mid = (low + high) / 2
        if 1.0 - tukey_upper(mid, groups, df) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


# Tail of the studentised range at even steps of its width. Above LARGE degrees of
# freedom it is read between the tails at LARGE and at infinity, in proportion to 1 / df.
STEP, STEPS, LARGE = 0.02, 600, 120


@cache
def _normal_gaps(scales: tuple[float, ...]) -> np.ndarray:
    """P(z < Z < z + width) at the nodes of z, for every step of width and every scale."""
    z = 8.5 * _NODES
    edge = 13.0 + STEP * STEPS * max(scales)
    fine = np.linspace(-8.5, edge, 1 << 16)
    cdf = 0.5 * (1.0 + np.array([math.erf(v / math.sqrt(2.0)) for v in fine]))
    widths = np.outer(np.arange(STEPS + 1) * STEP, scales)
    return np.clip(np.interp(z + widths[..., None], fine, cdf) - np.interp(z, fine, cdf), 0.0, 1.0)


@cache
def range_tails(groups: int, df: float | None) -> tuple[float, ...]:
    """P(studentised range > i * STEP) for i = 0..STEPS; ``df`` None stands for infinity."""
    scales, mass = (1.0,), np.ones(1)
    if df is not None:
        spread = 8.0 / math.sqrt(2.0 * df)
        low, high = max(1e-6, 1.0 - spread), 1.0 + spread
        nodes, weights = np.polynomial.legendre.leggauss(48)
        s = (high - low) / 2 * nodes + (high + low) / 2
        mass = np.exp(math.log(2.0) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2) * weights
        scales = tuple(s.tolist())
    z = 8.5 * _NODES
    density = 8.5 * _WEIGHTS * np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
    inside = groups * (_normal_gaps(scales) ** (groups - 1) @ density)
    tails = np.clip(1.0 - inside @ mass / mass.sum(), 0.0, 1.0)
    tails[0] = 1.0
    return tuple(np.minimum.accumulate(tails).tolist())


def tails_at(groups: int, df: float) -> list[float]:
    """The tails for given degrees of freedom."""
    if df < LARGE:
        return list(range_tails(groups, float(df)))
    share = LARGE / df
    return [a + (b - a) * share for a, b in zip(range_tails(groups, None), range_tails(groups, float(LARGE)))]


def width_at(tails: list[float], level: float) -> float:
    """The width that is exceeded with probability 1 - level."""
    i = next(i for i, tail in enumerate(tails) if tail <= 1 - level)
    return STEP * (i - (1 - level - tails[i]) / (tails[i - 1] - tails[i]))
