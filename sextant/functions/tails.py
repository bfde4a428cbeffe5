"""Tail probabilities of Student's t and Fisher's F.

Spark has no such functions, so they run as Arrow UDFs on result-sized frames
(one row per test).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float, y: float) -> float:
    """Continued fraction of the incomplete beta function by Didonato and Morris.

    It holds a y - b x instead of differences from 1, so it loses no digits when y is tiny.
    """
    value = c = a * (a * y - b * x + 1.0) / (a + 1.0)
    d = 0.0
    for m in range(1, 200_000):
        odd = a + 2 * m - 1
        top = (a + m - 1) / odd * (a + b + m - 1) / odd * m * (b - m) * x * x
        bottom = m + m * (b - m) * x / odd + (a + m) / (odd + 2) * (a * y - b * x + 1.0 + m * (1.0 + y))
        d = 1.0 / (bottom + top * d)
        c = bottom + top / c
        value *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return 1.0 / value


def _stirling_rest(a: float) -> float:
    """ln Γ(a) without its leading terms (a - 1/2) ln a - a + ln √(2π)."""
    if a < 10.0:
        return math.lgamma(a) - (a - 0.5) * math.log(a) + a - 0.5 * math.log(2 * math.pi)
    inverse = 1.0 / (a * a)
    return (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / a


def _log_beta_front(a: float, b: float, x: float, y: float) -> float:
    """ln of x^a y^b / B(a, b) for y = 1 - x; no difference of large logarithms is taken.

    The leading terms of the gamma functions join the powers: a ln(x (a+b) / a) and b ln(y (a+b) / b).
    """
    off = b * x - a * y  # x = (a + off) / (a + b), y = (b - off) / (a + b)
    powers = a * (math.log1p(off / a) if off > -0.5 * a else math.log(x / a * (a + b)))
    powers += b * (math.log1p(-off / b) if off < 0.5 * b else math.log(y / b * (a + b)))
    rest = _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b)
    return powers + rest + 0.5 * (math.log(a) - math.log1p(a / b) - math.log(2 * math.pi))


def regularized_beta(a: float, b: float, x: float, y: float | None = None) -> float:
    """I_x(a, b); ``y`` is 1 - x where the caller has it without loss."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - regularized_beta(b, a, y, x)
    return math.exp(_log_beta_front(a, b, x, y)) * _beta_fraction(a, b, x, y)


def f_upper(f: float, d1: float, d2: float) -> float:
    return regularized_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def t_two_sided(t: float, dof: float) -> float:
    return f_upper(t * t, 1.0, dof)


def _usable(*values: float) -> bool:
    return all(v is not None and math.isfinite(v) for v in values)


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic; null when it is undefined."""
    return pd.Series(
        [t_two_sided(a, b) if _usable(a, b) and b > 0 else None for a, b in zip(t, dof)], dtype="float64"
    )


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail p-value of an F statistic; null when it is undefined."""
    return pd.Series(
        [f_upper(a, b, c) if _usable(a, b, c) and b > 0 and c > 0 else None for a, b, c in zip(f, d1, d2)],
        dtype="float64",
    )
