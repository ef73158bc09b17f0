"""Robust scaling with exact quantiles.

``(x - median) / (Q3 - Q1)``; a zero IQR divides by 1 (Spark's
``RobustScaler`` maps such a column to 0 and is approximate, which would
erase mostly-zero tier columns).  Fit: one distributed quantile pass for
all columns at p = 0.25, 0.5, 0.75.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.functions import stats


def fit_robust_scaler(df: DataFrame, cols: Sequence[str], exact: bool = True) -> dict:
    q = stats.quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    out = {}
    for c in cols:
        q1, med, q3 = q[c]
        if med is None:
            out[c] = (0.0, 1.0)
            continue
        iqr = q3 - q1
        out[c] = (med, iqr if iqr != 0 else 1.0)
    return out


def apply_robust_scaler(df: DataFrame, params: dict) -> DataFrame:
    return df.select(*[((F.col(c).cast("double") - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c)
                       if c in params else F.col(c) for c in df.columns])


def robust_scale(df: DataFrame, cols: Sequence[str], params: dict | None = None,
                 exact: bool = True) -> DataFrame:
    params = params if params is not None else fit_robust_scaler(df, cols, exact)
    return apply_robust_scaler(df, params)
