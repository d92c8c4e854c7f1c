"""Two-sided p-values. Runs on result rows only, never on raw data."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def student_t_p(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with df degrees of freedom."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    a, b, x = df / 2.0, 0.5, df / (df + t * t)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x) if 0 < x < 1 else None
    if log_front is None:
        return 1.0 if x >= 1 else 0.0
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_t_p(a, b) for a, b in zip(t, df)], dtype="float64")


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation over n pairs; null below three pairs or at |r| = 1."""
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation; 0 at |r| = 1, null below three pairs."""
    p = F.nanvl(_t_p(F.coalesce(correlation_t(r, n), F.lit(0.0)), (n - 2).cast("double")), F.lit(None).cast("double"))
    return F.when((n > 2) & r.isNotNull(), F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(p))


def normal_p(z: float) -> float:
    """P(|Z| >= |z|) for a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2.0))
