"""De-duplication, imputation, feature-column resolution, filters
and table profiles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrascore.config import EXCLUDE_COLUMNS, TARGET_COLUMN
from terrascore.functions import stats
from terrascore.functions.expr import (FEATURE_TYPES, finite_or_zero, numeric_columns,
                                       string_columns)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication (NULL equals NULL).

    Planned as a hash aggregate with a map-side partial step, so a row
    copied a million times is collapsed before the shuffle.
    """
    return df.dropDuplicates()


def fit_median_impute(df: DataFrame, cols: Sequence[str] | None = None,
                      exact: bool = True) -> dict[str, float | None]:
    """P2 fit: exact median of every numeric column that has missing values."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    nulls = stats.null_counts(df, cols)
    need = [c for c in cols if nulls[c]]
    if not need:
        return {}
    q = stats.quantiles(df, need, [0.5], exact=exact)
    return {c: q[c][0] for c in need}


def apply_median_impute(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """P2 apply: ``coalesce(c, median)``; an imputed column becomes double.
    A column whose median is missing (all values missing) stays missing."""
    from terrascore.functions.expr import nan_to_null

    exprs = []
    for f in df.schema.fields:
        if f.name in medians and medians[f.name] is not None:
            exprs.append(F.coalesce(nan_to_null(F.col(f.name).cast("double")),
                                    F.lit(float(medians[f.name]))).alias(f.name))
        elif f.name in medians:
            exprs.append(nan_to_null(F.col(f.name).cast("double")).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def median_impute(df: DataFrame, cols: Sequence[str] | None = None, medians=None,
                  exact: bool = True) -> DataFrame:
    if medians is None:
        medians = fit_median_impute(df, cols, exact)
    return apply_median_impute(df, medians)


def fill_unknown(df: DataFrame, exclude: Iterable[str] = tuple(EXCLUDE_COLUMNS),
                 target: str = TARGET_COLUMN, value: str = "Unknown") -> DataFrame:
    """Missing strings -> 'Unknown', except excluded columns and target."""
    cols = string_columns(df, list(exclude) + [target])
    return df.fillna(value, subset=cols) if cols else df


def cast_target(df: DataFrame, target: str = TARGET_COLUMN) -> DataFrame:
    """Target to int (truncating)."""
    if target not in df.columns:
        return df
    return df.withColumn(target, F.col(target).cast("int"))


def clean_data_fit(df: DataFrame, exclude: Iterable[str] = tuple(EXCLUDE_COLUMNS),
                   target: str = TARGET_COLUMN, medians=None, exact: bool = True, complete: bool = True,
                   keys: Iterable[str] = ("sample_id",)):
    """P5 returning (cleaned frame, medians).  The state holds a median for
    every numeric column but keys, excluded columns and the target, since later
    rows can lack values where these do not; ``complete=False`` fits only what
    this frame needs.  When the medians are fitted
    here, the de-duplicated frame is written once to the checkpoint folder
    and read by the missing-value count, the median pass and the final
    projection, instead of shuffling the duplicates away three times; so it
    is where given medians call for a count of missing values."""
    d = drop_duplicates(df)
    if medians is None:
        from terrascore.session import materialize

        d = materialize(d, "dedup")
        needed = medians = fit_median_impute(d, exact=exact)
        if complete:
            rest = [c for c in numeric_columns(d) if c not in {*needed, *exclude, *keys, target}]
            medians = needed | {c: q[0] for c, q in stats.quantiles(d, rest, [0.5], exact=exact).items()}
        d = apply_median_impute(d, needed)
    else:
        # a column that lacks nothing keeps its type
        whole = [f.name for f in d.schema.fields if f.name in medians and isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))]
        if whole:
            from terrascore.session import materialize

            d = materialize(d, "dedup")
        lacking = stats.null_counts(d, whole)
        d = apply_median_impute(d, {c: m for c, m in medians.items() if lacking.get(c, 1)})
    d = fill_unknown(d, exclude, target)
    return cast_target(d, target), medians


def clean_data(df: DataFrame, exclude: Iterable[str] = tuple(EXCLUDE_COLUMNS),
               target: str = TARGET_COLUMN, medians=None, exact: bool = True) -> DataFrame:
    """P5: P1 -> P2 -> P3 -> P4 (de-duplicate before the medians)."""
    return clean_data_fit(df, exclude, target, medians, exact, complete=False)[0]


def feature_columns(df: DataFrame, exclude: Iterable[str] = tuple(EXCLUDE_COLUMNS),
                    target: str = TARGET_COLUMN, id_col: str | None = "sample_id") -> list[str]:
    """double/float/long/int columns minus excludes, target and key
    (booleans such as band dummies are not features)."""
    ex = set(exclude) | {target} | ({id_col} if id_col else set())
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, FEATURE_TYPES) and f.name not in ex]


def prepare_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project the frozen feature list; missing and +-inf -> 0.
    Columns absent from ``df`` are created as 0 (a scoring table may lack one)."""
    have = set(df.columns)
    out = [F.col(k) for k in keep]
    for c in columns:
        out.append((finite_or_zero(c) if c in have else F.lit(0.0)).alias(c))
    return df.select(*out)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(feature, n_missing) for columns with at least one missing value."""
    cols = list(cols) if cols is not None else list(df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_missing")) for c in cols])
    return counts.select(F.inline(arr)).where(F.col("n_missing") > 0)


def filter_membership(df: DataFrame, column: str, values) -> DataFrame:
    """P10: keep rows whose ``column`` is in ``values``.

    ``values`` is a Python collection (an ``IN`` list, pushed into the
    scan) or a one-column DataFrame (its distinct values are written once
    and joined as a left semi join, broadcast if their measured size is
    small).
    """
    if isinstance(values, DataFrame):
        from terrascore.session import join_lookup, materialize

        key = values.columns[0]
        known = materialize(values.select(F.col(key).alias(column)).distinct(), "known")
        return join_lookup(df, known, column, "left_semi")
    return df.where(F.col(column).isin(list(values)))


def filter_range(df: DataFrame, column: str, max_value: float | None = None,
                 min_value: float | None = None) -> DataFrame:
    """Inclusive bounds; missing values drop out."""
    cond = F.col(column).isNotNull()
    if max_value is not None:
        cond = cond & (F.col(column) <= F.lit(max_value))
    if min_value is not None:
        cond = cond & (F.col(column) >= F.lit(min_value))
    return df.where(cond)


def feature_override(selected: Sequence[str], include: Sequence[str] = (),
                     exclude: Sequence[str] = ()) -> list[str]:
    """(selected + include) minus exclude, first-seen order, no duplicates,
    names that are not present are tolerated."""
    out, seen = [], set()
    ex = set(exclude)
    for c in list(selected) + list(include):
        if c not in seen and c not in ex:
            out.append(c)
            seen.add(c)
    return out


def target_distribution(df: DataFrame, target: str = TARGET_COLUMN) -> DataFrame:
    """Count and share per class."""
    total = F.sum("n").over(_whole())
    g = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col(target), F.col("n"), (F.col("n") / total).alias("share"))


def _whole():
    from pyspark.sql import Window
    # Over the already-aggregated class table (one row per class).
    return Window.partitionBy(F.lit(1))


def column_profile(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Min / max / mean / median of each column, long form."""
    spark = df.sparkSession
    agg = stats.one_pass(df, {**{f"min__{c}": F.min(F.col(c).cast("double")) for c in cols},
                              **{f"max__{c}": F.max(F.col(c).cast("double")) for c in cols},
                              **{f"avg__{c}": F.avg(F.col(c).cast("double")) for c in cols}})
    med = stats.quantiles(df, cols, [0.5], exact=exact)
    rows = [(c, agg[f"min__{c}"], agg[f"max__{c}"], agg[f"avg__{c}"], med[c][0]) for c in cols]
    schema = T.StructType([T.StructField("feature", T.StringType(), False)] + [
        T.StructField(n, T.DoubleType(), True) for n in ("min", "max", "mean", "median")])
    return spark.createDataFrame(rows, schema)
