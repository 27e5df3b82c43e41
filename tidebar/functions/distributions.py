"""Tails of Student's t and of F from the regularised incomplete beta function, and block bootstraps, in numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebar.params import BOOTSTRAP_ROUNDS, BOOTSTRAP_SEED

_TINY = 1e-300


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by the continued fraction of Lentz, on the side where it converges fast."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + step * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + step / c
        c = c if abs(c) > _TINY else _TINY
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_two_sided(t: float, df: float) -> float:
    if not (math.isfinite(t) and df > 0):
        return math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if not (math.isfinite(f) and d1 > 0 and d2 > 0):
        return math.nan
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(f, 0.0)))


def _nulls(values: list[float]) -> pd.Series:
    return pd.Series([None if v is None or math.isnan(v) else v for v in values], dtype=object)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value; for small results, one row a test."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return _nulls([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else math.nan for a, b in zip(t, df, strict=True)])

    return p(t.cast("double"), df.cast("double"))


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def p(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return _nulls([f_upper(x, y, z) if pd.notna(x) and pd.notna(z) else math.nan for x, y, z in zip(f, a, b, strict=True)])

    return p(f.cast("double"), d1.cast("double"), d2.cast("double"))


#: Elements gathered at once.
_GATHER = 5_000_000


def block_length(n: int) -> int:
    return max(10, round(n ** (1 / 3)))


def _interval(means: np.ndarray) -> tuple[float, float]:
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def moving_block_ci(values: np.ndarray, block: int, rounds: int = BOOTSTRAP_ROUNDS, seed: int = BOOTSTRAP_SEED) -> tuple[float, float]:
    """95 % interval of the mean: blocks laid end to end and cut to the sample's length."""
    values = values[~np.isnan(values)]
    n = len(values)
    if n == 0 or n < 2 * block:
        return math.nan, math.nan
    rng, blocks = np.random.default_rng(seed), -(-n // block)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    tail = n - (blocks - 1) * block  # the last block's part
    size = max(1, _GATHER // max(1, blocks * block))
    means: list[np.ndarray] = []
    for begin in range(0, rounds, size):
        starts = rng.integers(0, n - block + 1, size=(min(size, rounds - begin), blocks))
        whole = (sums[starts[:, :-1] + block] - sums[starts[:, :-1]]).sum(axis=1)
        means.append((whole + sums[starts[:, -1] + tail] - sums[starts[:, -1]]) / n)
    return _interval(np.concatenate(means))


def _resampled(values: np.ndarray, block: int, rounds: int, rng: np.random.Generator, at_once: int | None) -> np.ndarray:
    """Means of rounds samples of whole blocks, from the means of all blocks."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    of_blocks = (sums[block:] - sums[:-block]) / block
    count = max(1, len(values) // block)
    size = at_once or max(1, _GATHER // count)
    parts = [of_blocks[rng.integers(0, len(of_blocks), size=(min(size, rounds - b), count))].mean(axis=1) for b in range(0, rounds, size)]
    return np.concatenate(parts)


def block_mean_ci(values: np.ndarray, block: int, rounds: int = BOOTSTRAP_ROUNDS, seed: int = BOOTSTRAP_SEED) -> tuple[float, float]:
    """The same from floor(n / block) whole blocks a round."""
    values = values[~np.isnan(values)]
    if len(values) == 0 or len(values) < 2 * block:
        return math.nan, math.nan
    return _interval(_resampled(values, block, rounds, np.random.default_rng(seed), None))


def difference_ci(a: np.ndarray, b: np.ndarray, rounds: int = BOOTSTRAP_ROUNDS, seed: int = BOOTSTRAP_SEED) -> tuple[float, float]:
    """95 % interval of mean(a) - mean(b), each resampled on its own; both need 20 values."""
    a, b = a[~np.isnan(a)], b[~np.isnan(b)]
    if len(a) < 20 or len(b) < 20:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    x, y = (_resampled(v, block_length(len(v)), rounds, rng, rounds) for v in (a, b))
    return _interval(x - y)
