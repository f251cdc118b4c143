"""Upper tails of the chi-square, F and t distributions for one-row test results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: power series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    return scale * _fraction(x + 1 - a, lambda i: i * (a - i), lambda i: x + 2 * i + 1 - a)


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a

    def step(i: int) -> float:
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    return scale * _fraction(1.0, step, lambda i: 1.0)


def _fraction(b0: float, num, den) -> float:
    """1/(b0 + num(1)/(den(1) + num(2)/(den(2) + ...))), evaluated forward until it settles."""
    tiny = 1e-300
    value = b0 or tiny
    c, d = value, 0.0
    for i in range(1, 100000):
        d = 1.0 / ((den(i) + num(i) * d) or tiny)
        c = (den(i) + num(i) / c) or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return 1.0 / value


def chi2_tail(stat: float, dof: float) -> float:
    return _gamma_tail(dof / 2, stat / 2)


def f_tail(stat: float, d1: float, d2: float) -> float:
    return _beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * stat))


def t_two_sided(stat: float, dof: float) -> float:
    return _beta_share(dof / 2, 0.5, dof / (dof + stat * stat))


def _column(fn, *args: pd.Series) -> pd.Series:
    rows = zip(*args)
    return pd.Series([None if any(pd.isna(v) for v in r) else fn(*map(float, r)) for r in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return _column(chi2_tail, stat, dof)


@F.pandas_udf(T.DoubleType())
def f_p(stat: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _column(f_tail, stat, d1, d2)


@F.pandas_udf(T.DoubleType())
def t_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return _column(t_two_sided, stat, dof)
