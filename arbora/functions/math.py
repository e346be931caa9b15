"""Column functions of the scores: log-gamma, mixed radix, chi-square tails, precision and recall."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lgamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: the recurrence up to x + 8, then Stirling's series. Stays in whole-stage codegen."""
    y = x + 8
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    r = 1 / y
    r2 = r * r
    series = r * (F.lit(1 / 12) - r2 * (F.lit(1 / 360) - r2 * (F.lit(1 / 1260) - r2 * (F.lit(1 / 1680) - r2 * F.lit(1 / 1188)))))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def lgamma_array(x: np.ndarray) -> np.ndarray:
    """lgamma() of an array."""
    y = x + 8
    product = x.copy()
    for i in range(1, 8):
        product *= x + i
    r2 = 1 / (y * y)
    series = (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 * (1 / 1680 - r2 / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def mixed_radix(columns: Sequence[Column], cards: Sequence[int]) -> Column:
    """The configuration index of the columns, the last one the least significant digit; 0 for none."""
    out = F.lit(0).cast("long")
    for c, r in zip(columns, cards, strict=True):
        out = out * int(r) + c.cast("long")
    return out


def digits(j: Column, cards: Sequence[int]) -> list[Column]:
    """mixed_radix() undone."""
    out, step = [], 1
    for r in reversed(cards):
        out.append((F.floor(j / step) % int(r)).cast("int"))
        step *= int(r)
    return out[::-1]


def _gamma_tail(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: a series below s + 1, a continued fraction beyond."""
    out = np.ones(len(x))
    front = np.exp(s * np.log(np.maximum(x, 1e-300)) - x - np.array([math.lgamma(v) for v in s]))
    low = (x > 0) & (x < s + 1)
    term = np.where(low, 1 / s, 0.0)
    total = term.copy()
    n = s.copy()
    for _ in range(2000):
        n = n + 1
        term = term * x / n
        total += term
        if not (np.abs(term[low]) > 1e-16 * np.abs(total[low])).any():
            break
    out[low] = 1 - total[low] * front[low]
    high = x >= s + 1
    if high.any():
        a, z = s[high], x[high]
        b = z + 1 - a
        c = np.full(len(z), 1e300)
        d = 1 / b
        h = d.copy()
        for i in range(1, 2000):
            k = -i * (i - a)
            b = b + 2
            d = 1 / np.where(np.abs(k * d + b) < 1e-300, 1e-300, k * d + b)
            c = b + k / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h *= d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = front[high] * h
    return np.clip(out, 0, 1)


def tail(stat: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of the chi-square distribution; 1 for no degrees of freedom or a statistic that isn't positive."""
    s, x = df / 2, stat / 2
    good = (s > 0) & (x > 0)
    out = np.ones(len(s))
    if good.any():
        out[good] = _gamma_tail(s[good], x[good])
    return out


@F.pandas_udf(DoubleType())
def chi2_tail(stat: pd.Series, df: pd.Series) -> pd.Series:
    """tail() of columns. For tables of pairs, not of rows."""
    return pd.Series(tail(stat.to_numpy(float), df.to_numpy(float)))


def ratio(a: Column, b: Column, both_empty: float) -> Column:
    """a / b; both_empty where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(float(both_empty)))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
