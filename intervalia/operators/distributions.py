"""Distribution functions and quantiles of the normal, chi-squared, t and F distributions, over arrays."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_share(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inner = np.clip(x, 0.0, 1.0)
    turn = inner > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - inner, inner)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + step * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + step / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * c * d
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(turn, 1 - out, out)


def gamma_share(a, x) -> np.ndarray:
    """The regularised lower incomplete gamma function, by its series below a + 1 and its continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0.0))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.where(x > 0, np.exp(a * np.log(x) - x - _lgamma(a)), 0.0)
        term = total = 1 / a
        for k in range(1, 2000):
            term = term * x / (a + k)
            total = total + term
            if np.all((term < 1e-16 * total) | (x > a + 1)):
                break
        b = x + 1 - a
        c, d = np.full_like(b, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for k in range(1, 2000):
            an = -k * (k - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * c * d
            if np.all((np.abs(c * d - 1) < 1e-15) | (x <= a + 1)):
                break
    return np.where(x <= a + 1, front * total, 1 - front * h)


def normal_cdf(z) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(z, float) / math.sqrt(2))


def chi2_cdf(x, dof) -> np.ndarray:
    return gamma_share(np.asarray(dof, float) / 2, np.asarray(x, float) / 2)


def t_cdf(t, dof) -> np.ndarray:
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    tail = 0.5 * beta_share(dof / 2, 0.5, dof / (dof + t * t))
    return np.where(t < 0, tail, 1 - tail)


def t_two_sided(t, dof) -> np.ndarray:
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return beta_share(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f, top, bottom) -> np.ndarray:
    """The chance of a larger F."""
    f, top, bottom = (np.asarray(v, float) for v in (f, top, bottom))
    return np.where(f > 0, beta_share(bottom / 2, top / 2, bottom / (bottom + top * np.maximum(f, 0))), 1.0)


def _quantile(cdf, p, lo: float, hi: float) -> np.ndarray:
    p = np.asarray(p, float)
    a, b = np.full(p.shape, lo), np.full(p.shape, hi)
    for _ in range(60):
        if np.all(cdf(b) >= p):
            break
        b = np.where(cdf(b) < p, b * 2, b)
    for _ in range(60):
        if lo == 0 or np.all(cdf(a) <= p):
            break
        a = np.where(cdf(a) > p, a * 2, a)
    for _ in range(100):
        m = (a + b) / 2
        below = cdf(m) < p
        a, b = np.where(below, m, a), np.where(below, b, m)
    return (a + b) / 2


def normal_quantile(p) -> np.ndarray:
    return _quantile(normal_cdf, p, -1.0, 1.0)


def chi2_quantile(p, dof) -> np.ndarray:
    p, dof = np.broadcast_arrays(np.asarray(p, float), np.asarray(dof, float))
    return _quantile(lambda x: chi2_cdf(x, dof), p, 0.0, 1.0)


def t_quantile(p, dof) -> np.ndarray:
    p, dof = np.broadcast_arrays(np.asarray(p, float), np.asarray(dof, float))
    return _quantile(lambda x: t_cdf(x, dof), p, -1.0, 1.0)


def f_quantile(p, top, bottom) -> np.ndarray:
    p, top, bottom = np.broadcast_arrays(*(np.asarray(v, float) for v in (p, top, bottom)))
    return _quantile(lambda x: 1 - f_tail(x, top, bottom), p, 0.0, 1.0)
