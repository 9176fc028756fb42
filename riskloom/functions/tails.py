"""Tail probabilities as column functions.

Spark has no F, t, binomial or hypergeometric tail. These are vectorised helpers for frames that
are already aggregated: one row per test, never one row per observation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(np.frompyfunc(math.lgamma, 1, 1)(x), dtype=float)


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """log gamma(z) less its leading terms (z - 1/2) log z - z + log(2 pi) / 2."""
    near = np.minimum(z, 20.0)
    exact = _lgamma(near) - ((near - 0.5) * np.log(near) - near + 0.5 * math.log(2 * math.pi))
    far = np.maximum(z, 20.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * far * far)) / (far * far)) / (far * far)) / far
    return np.where(z < 20, exact, series)


def log_factorial(k: np.ndarray) -> np.ndarray:
    z = np.asarray(k, dtype=float) + 1
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + _stirling_rest(z)


def _beta_front(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x^a (1 - x)^b / B(a, b), from terms that are small near the mean, so nothing cancels at any size."""
    n = a + b
    bulk = a * np.log1p((x * n - a) / a) + b * np.log1p((a - x * n) / b)
    rest = _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b)
    return np.exp(bulk + rest + 0.5 * (np.log(a) + np.log(b) - np.log(n) - math.log(2 * math.pi)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral, modified Lentz steps."""
    tiny = 1e-300

    def off_zero(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / off_zero(1.0 - (a + b) * x / (a + 1.0))
    out = d.copy()
    # it settles after a few times the root of the larger shape
    for m in range(1, 200 + 20 * math.isqrt(int(max(a.max(initial=1), b.max(initial=1))))):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = out
        for term in (even, odd):
            d = 1.0 / off_zero(1.0 + term * d)
            c = off_zero(1.0 + term / c)
            out = out * c * d
        if np.all(np.abs(out - before) <= 1e-15 * np.abs(out)):
            break
    return out


def beta_cdf(a, b, x) -> np.ndarray:
    """Regularised incomplete beta integral up to ``x``."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    known = (a > 0) & (b > 0) & ~np.isnan(x)
    out[known & (x <= 0)] = 0.0
    out[known & (x >= 1)] = 1.0
    inside = known & (x > 0) & (x < 1)
    if inside.any():
        aa, bb, xx = a[inside], b[inside], x[inside]
        swap = xx > (aa + 1) / (aa + bb + 2)
        p, q, y = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
        part = _beta_front(p, q, y) / p * _beta_fraction(p, q, y)
        out[inside] = np.where(swap, 1 - part, part)
    return out


def f_tail(stat, df1, df2) -> np.ndarray:
    """P(F > stat)."""
    stat, df1, df2 = (np.asarray(v, dtype=float) for v in (stat, df1, df2))
    return beta_cdf(df2 / 2, df1 / 2, df2 / (df2 + df1 * stat))


def t_two_sided(stat, df) -> np.ndarray:
    stat, df = np.asarray(stat, dtype=float), np.asarray(df, dtype=float)
    return beta_cdf(df / 2, 0.5, df / (df + stat * stat))


def binomial_upper(k, n, p) -> np.ndarray:
    """P(X >= k)."""
    k, n, p = (np.asarray(v, dtype=float) for v in (k, n, p))
    return np.where(k <= 0, 1.0, beta_cdf(np.maximum(k, 1.0), n - np.maximum(k, 1.0) + 1, p))


def beta_quantile(prob: float, a, b) -> np.ndarray:
    """Inverse of :func:`beta_cdf` by halving."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (low + high) / 2
        under = beta_cdf(a, b, mid) < prob
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def exact_interval(k, n, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Exact binomial confidence limits of k successes in n."""
    k, n = np.asarray(k, dtype=float), np.asarray(n, dtype=float)
    side = (1 - level) / 2
    low = np.where(k == 0, 0.0, beta_quantile(side, np.maximum(k, 1e-9), n - k + 1))
    high = np.where(k == n, 1.0, beta_quantile(1 - side, k + 1, np.maximum(n - k, 1e-9)))
    return low, high


def chi_one_tail(stat) -> np.ndarray:
    """Upper tail of chi-square with one degree of freedom."""
    stat = np.asarray(stat, dtype=float)
    tail = np.frompyfunc(lambda s: math.erfc(math.sqrt(s / 2)) if s >= 0 else math.nan, 1, 1)
    return np.asarray(tail(stat), dtype=float)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of one 2 x 2 table.

    Cell probabilities follow from the most likely table by a ratio recurrence. Cells further
    than ``reach`` from it have probability below the smallest double, so they add nothing.
    """
    row, col, total = a + b, a + c, a + b + c + d
    lowest, highest = max(0, row + col - total), min(row, col)
    if lowest == highest:
        return 1.0
    mode = min(max((row + 1) * (col + 1) // (total + 2), lowest), highest)
    reach = int(math.sqrt(750 * min(row, col, total - row, total - col)) + 50)
    if abs(a - mode) > reach:
        return 0.0
    x = np.arange(max(lowest, mode - reach), min(highest, mode + reach) + 1, dtype=float)
    step = np.log(row - x[:-1]) + np.log(col - x[:-1]) - np.log(x[1:]) - np.log(total - row - col + x[1:])
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.exp(log_p - log_p.max())
    seen = weight[a - int(x[0])]
    return float(min(1.0, weight[weight <= seen * (1 + 1e-7)].sum() / weight.sum()))


def _log_binomial(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log of the binomial probability of k in n, by deviances; -inf outside 0 ... n."""
    good = (k >= 0) & (k <= n)
    k, n, p = np.where(good, k, 0.0), np.maximum(n, 0.0), np.clip(p, 1e-300, 1 - 1e-16)
    inner = (k > 0) & (k < n)
    kk, nn = np.where(inner, k, 1.0), np.where(inner, n, 2.0)
    with np.errstate(divide="ignore"):  # an impossible count has log probability -inf
        bulk = kk * np.log1p((nn * p - kk) / kk) + (nn - kk) * np.log1p((kk - nn * p) / (nn - kk))
    # k! is gamma(k) k: the leading terms give sqrt(n / (2 pi k (n - k)))
    rest = _stirling_rest(nn) - _stirling_rest(kk) - _stirling_rest(nn - kk) + 0.5 * (np.log(nn) - np.log(kk) - np.log(nn - kk) - math.log(2 * math.pi))
    edge = np.where(k == 0, n * np.log1p(-p), n * np.log(p))
    return np.where(good, np.where(inner, bulk + rest, edge), -np.inf)


def log_hypergeometric(k, good, bad, take) -> np.ndarray:
    """log probability of k good among ``take`` drawn without replacement."""
    k, good, bad, take = (np.asarray(v, dtype=float) for v in (k, good, bad, take))
    p = take / np.maximum(good + bad, 1)
    return _log_binomial(k, good, p) + _log_binomial(take - k, bad, p) - _log_binomial(take, good + bad, p)


def draw_hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Random counts of good among ``take`` without replacement, exact at every size.

    Ratio-of-uniforms rejection under the hat of Stadlober (1989), which needs the probability at the
    mode and at the point tried, nothing more.
    """
    good, bad, take = (np.asarray(v, dtype=np.int64) for v in np.broadcast_arrays(good, bad, take))
    total = good + bad
    low, high = np.maximum(0, take - bad), np.minimum(good, take)
    share = good / np.maximum(total, 1)
    mean = take * share
    spread = np.sqrt(mean * (1 - share) * (total - take) / np.maximum(total - 1, 1) + 0.5)
    mode = np.clip(np.floor((take + 1.0) * ((good + 1.0) / (total + 2.0))), low, high)
    top = log_hypergeometric(mode, good, bad, take)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    out = low.copy()
    open_ = np.flatnonzero(high > low)
    while len(open_):
        u, v = 1 - rng.random(len(open_)), rng.random(len(open_))
        tried = np.floor(mean.flat[open_] + 0.5 + width.flat[open_] * (v - 0.5) / u)
        inside = (tried >= low.flat[open_]) & (tried <= high.flat[open_])
        tried = np.where(inside, tried, low.flat[open_])
        gain = log_hypergeometric(tried, good.flat[open_], bad.flat[open_], take.flat[open_]) - top.flat[open_]
        taken = inside & (2 * np.log(u) <= gain)
        out.flat[open_[taken]] = tried[taken].astype(np.int64)
        open_ = open_[~taken]
    return out


def draw_tables(rng: np.random.Generator, rows: np.ndarray, cols: np.ndarray, times: int) -> np.ndarray:
    """``times`` random tables with the given margins: each row draws from what the columns have left."""
    out = np.empty((times, len(rows), len(cols)), dtype=np.int64)
    left = np.tile(cols, (times, 1))
    for i, size in enumerate(rows[:-1]):
        need = np.full(times, size)
        rest = left.sum(axis=1)
        for j in range(len(cols) - 1):
            rest = rest - left[:, j]
            out[:, i, j] = draw_hypergeometric(rng, left[:, j], rest, need)
            need = need - out[:, i, j]
        out[:, i, -1] = need
        left = left - out[:, i]
    out[:, -1] = left
    return out


def split_counts(rng: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """For each row of counts how many of each kind are among ``size`` drawn without replacement."""
    out = np.empty_like(left)
    need, rest = np.full(len(left), size), left.sum(axis=1)
    for j in range(left.shape[1] - 1):
        rest = rest - left[:, j]
        out[:, j] = draw_hypergeometric(rng, left[:, j], rest, need)
        need = need - out[:, j]
    out[:, -1] = need
    return out


@F.pandas_udf(T.DoubleType())
def f_tail_col(stat: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_tail(stat, df1, df2))


@F.pandas_udf(T.DoubleType())
def t_tail_col(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(stat, df))


@F.pandas_udf(T.DoubleType())
def fisher_col(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(int(i), int(j), int(k), int(m)) for i, j, k, m in zip(a, b, c, d)], dtype=float)
