"""Distribution functions that Spark lacks, as Pandas UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not 0 <= x <= 1 or math.isnan(a + b):
        return math.nan
    if x in (0, 1):
        return float(x)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if not (math.isfinite(t) and math.isfinite(df) and df > 0):
        return math.nan
    return betainc(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    p = [t_p(float(a), float(b)) if a is not None and b is not None else math.nan for a, b in zip(t, df, strict=True)]
    return pd.Series([None if math.isnan(x) else x for x in p], dtype="float64")
