"""Null-safe column expressions shared by all operators.

The reference works in IEEE arithmetic (x/0 = inf, 0/0 = NaN) and turns
inf and NaN into 0 at the end.  Spark 4 runs ANSI, where a division by
zero raises, so every division goes through ``safe_div`` (NULL on a zero
denominator) and ``finite_or_zero`` maps NULL, NaN and +-inf to 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)
FEATURE_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)
FLOAT_TYPES = (T.DoubleType, T.FloatType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote(name: str) -> str:
    """Backtick-quote a column name for SQL text (names like ``SiO2_%``)."""
    return "`" + name.replace("`", "``") + "`"


def nan_to_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """IEEE-like division whose non-finite results become NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def finite_or_zero(c: str | Column) -> Column:
    """NULL, NaN, +inf and -inf -> 0.0 (the reference's final clean-up)."""
    x = col(c).cast("double")
    # NaN is above infinity.  Kept short: a projection of many columns whose
    # generated code is too long is interpreted
    return F.coalesce(F.when(F.abs(x) < F.lit(float("inf")), x), F.lit(0.0))


def add_all(cols: Sequence[str | Column]) -> Column:
    """Plain sum: NULL if any term is NULL (pandas column arithmetic)."""
    cs = [col(c) for c in cols]
    out = cs[0]
    for c in cs[1:]:
        out = out + c
    return out


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Row sum with missing = 0 (pandas ``sum(axis=1)``)."""
    return add_all([F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])


def ratio(num: str | Column, den: str | Column, eps: float = 0.0) -> Column:
    d = col(den).cast("double")
    if eps:
        d = d + F.lit(float(eps))
    return safe_div(num, d)


def share_index(num_cols: Sequence[str], den_extra: Sequence[str], scale: float = 100.0,
                eps: float = 0.0) -> Column:
    """sum(num) / (sum(num) + sum(den_extra) + eps) * scale."""
    num = add_all(num_cols)
    den = add_all(list(num_cols) + list(den_extra))
    if eps:
        den = den + F.lit(float(eps))
    return safe_div(num, den) * F.lit(float(scale))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = (), types=NUMERIC_TYPES) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ex]


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every float column, in one projection."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES):
            exprs.append(nan_to_null(F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def unpivot_columns(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
                    key: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> long, values cast to double."""
    arr = F.array(*[F.struct(F.lit(c).alias(key), F.col(c).cast("double").alias(value))
                    for c in value_cols])
    return df.select(*[F.col(c) for c in id_cols], F.inline(arr))
