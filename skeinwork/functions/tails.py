"""Tails and quantiles of the usual distributions, in numpy, on arrays."""

from __future__ import annotations

from math import lgamma

import numpy as np

_TINY = 1e-300


def _log_gamma(x):
    return np.vectorize(lgamma, otypes=[float])(x)


def log_beta(a, b):
    return _log_gamma(a) + _log_gamma(b) - _log_gamma(np.add(a, b))


def log_incomplete_beta(a, b, x):
    """ln I_x(a, b), by Lentz's continued fraction; tails far below the least double keep their logarithm."""
    a, b, x = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        out = p * np.log(y) + q * np.log1p(-y) - log_beta(p, q) - np.log(p) + np.log(h)
        return np.where(swap, np.log1p(-np.minimum(np.exp(out), 1.0)), out)


def t_two_sided(t, df):
    """P(|T| > |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.exp(log_incomplete_beta(df / 2, 0.5, df / (df + t * t)))


def pearson_p(r, n):
    """Two-sided p of a correlation of n pairs."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    return np.where(np.abs(r) >= 1, 0.0, np.exp(log_incomplete_beta((n - 2) / 2, 0.5, 1 - np.minimum(r * r, 1))))


def log_gamma_tail(a, x):
    """ln Q(a, x), the upper regularised incomplete gamma function."""
    a, x = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(a, x))
    out = np.zeros_like(x)
    low = x < a + 1
    if low.any():
        p, y = a[low], np.maximum(x[low], _TINY)
        term = total = 1 / p
        for k in range(1, 2000):
            term = term * y / (p + k)
            total = total + term
            if np.all(term < total * 1e-16):
                break
        out[low] = np.log1p(-np.minimum(total * np.exp(p * np.log(y) - y - _log_gamma(p)), 1 - 1e-16))
    if (~low).any():
        p, y = a[~low], x[~low]
        b, c = y + 1 - p, np.full_like(y, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for k in range(1, 2000):
            s = -k * (k - p)
            b = b + 2
            d = 1 / np.where(np.abs(s * d + b) < _TINY, _TINY, s * d + b)
            c = np.where(np.abs(b + s / c) < _TINY, _TINY, b + s / c)
            h *= d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[~low] = p * np.log(y) - y - _log_gamma(p) + np.log(h)
    return out


def chi2_tail(x, df):
    return np.exp(log_gamma_tail(np.asarray(df, float) / 2, np.asarray(x, float) / 2))


def _bisect(f, p, lo, hi):
    p = np.atleast_1d(np.asarray(p, float))
    lo, hi = np.broadcast_to(np.asarray(lo, float), p.shape).copy(), np.broadcast_to(np.asarray(hi, float), p.shape).copy()
    for _ in range(200):
        mid = (lo + hi) / 2
        under = f(mid) < p
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


def beta_quantile(p, a, b):
    return _bisect(lambda x: np.exp(log_incomplete_beta(a, b, x)), p, 0.0, 1.0)


def t_quantile(p, df):
    def cdf(t):
        tail = t_two_sided(t, df) / 2
        return np.where(t < 0, tail, 1 - tail)

    return _bisect(cdf, p, -1e6, 1e6)


def normal_cdf(x):
    from math import erfc, sqrt

    return np.vectorize(lambda v: 0.5 * erfc(-v / sqrt(2)), otypes=[float])(x)


def normal_quantile(p):
    return _bisect(normal_cdf, p, -40.0, 40.0)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of the table [[a, b], [c, d]]: all tables of its margins that are no likelier."""
    r1, c1, n = a + b, a + c, a + b + c + d
    x = np.arange(max(0, r1 + c1 - n), min(r1, c1) + 1)
    lf = lambda v: _log_gamma(np.asarray(v, float) + 1)
    logs = lf(r1) + lf(n - r1) + lf(c1) + lf(n - c1) - lf(n) - lf(x) - lf(r1 - x) - lf(c1 - x) - lf(n - r1 - c1 + x)
    mine = logs[a - x[0]]
    return float(min(1.0, np.exp(logs[logs <= mine + 1e-7]).sum()))
