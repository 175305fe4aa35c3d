"""Tail probabilities of the normal and t distributions as -log10, exact far into the tails, over arrays."""

from __future__ import annotations

import math

import numpy as np


def _each(f, x: np.ndarray) -> np.ndarray:
    return np.array([f(v) for v in x.ravel()], float).reshape(x.shape)


def neglog_erfc(x: np.ndarray) -> np.ndarray:
    """-log10(erfc(x)) for x of 0 and more: by the library's erfc, and by its asymptotic series where that would underflow."""
    x = np.asarray(x, float)
    far = np.maximum(x, 20.0)
    inverse = 1 / (2 * far * far)
    series = 1 - inverse + 3 * inverse**2 - 15 * inverse**3
    tail = (far * far + np.log(far * math.sqrt(math.pi)) - np.log(series)) / math.log(10)
    return np.where(x < 20, -np.log10(np.maximum(_each(math.erfc, np.minimum(x, 20.0)), 1e-300)), tail)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz recursion."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def neglog_t(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """-log10 of the two-sided tail P(|T| > |t|) with df degrees of freedom; nan where t or df is, or df is not positive."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    good = np.isfinite(t) & (df > 0)
    t, df = np.where(good, np.abs(t), 0.0), np.where(good, df, 1.0)
    # P is the regularised incomplete beta function of x = df / (df + t^2) with df/2 and 1/2
    x, rest = df / (df + t * t), t * t / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    front = _each(math.lgamma, a + b) - _each(math.lgamma, a) - math.lgamma(0.5) + a * np.log(x) + b * np.log(np.maximum(rest, 1e-300))
    direct = x < (a + 1) / (a + b + 2)
    near = np.where(direct, a, b), np.where(direct, b, a), np.where(direct, x, rest)
    value = front + np.log(_beta_fraction(*near) / near[0])
    log = np.where(direct, value, np.log1p(-np.minimum(np.exp(np.minimum(value, 0.0)), 1 - 1e-16)))
    return np.where(good, np.where(t == 0, 0.0, -log / math.log(10)), np.nan)
