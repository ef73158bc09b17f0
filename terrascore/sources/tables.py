"""Table loading.

``load_table`` reads CSV (header, inferred schema), Parquet, or the
dBase source by extension or explicit format, drops a ``geometry``
column, and converts NaN to NULL on every float column so that only
NULL means "missing" from here on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrascore.functions.expr import nan_to_null_all

EXCLUDED_ON_LOAD = ("geometry",)


def load_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema=None, where=None) -> DataFrame:
    """Read a table; ``where`` (a Column) is applied to the raw scan, before
    the NaN -> NULL projection, so comparison and IN predicates reach the
    Parquet reader as pushed filters (a predicate over the projected
    column would not be translatable)."""
    fmt = fmt or _guess_format(path)
    if fmt == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    elif fmt == "dbf":
        from terrascore.sources.dbf import register_dbf

        register_dbf(spark)
        df = spark.read.format("dbf").load(path)
    else:
        df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    drop = [c for c in EXCLUDED_ON_LOAD if c in df.columns]
    if drop:
        df = df.drop(*drop)
    return nan_to_null_all(df)


def _guess_format(path: str) -> str:
    p = path.lower().rstrip("/")
    if p.endswith(".csv"):
        return "csv"
    if p.endswith(".dbf"):
        return "dbf"
    return "parquet"


def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's base tables (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
