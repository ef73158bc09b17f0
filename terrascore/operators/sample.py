"""Repeatable stratified split and stratified folds.

Row order comes from ``md5(<key>:<seed>)`` -- a pure function of the row,
so the split is the same on every run and every engine (the DuckDB
oracle computes the same hex digest).

* ``stratified_split`` (exact): per class the ``ceil(test_size * n_class)``
  rows with the smallest hash go to the test part.  Ranks come from the
  distributed prefix-sum helper, never a per-class window (a class can
  hold half of all rows).
* ``hash_split`` (streaming-friendly, no shuffle): test if the first 32
  bits of the hash are below ``test_size * 2^32``; sizes are then
  binomial rather than exact.
* ``stratified_folds``: fold = (rank - 1) mod k within each class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.config import CV_FOLDS, RANDOM_STATE, TEST_SIZE
from terrascore.operators.ranks import ordinal_rank


def row_hash(key: str, seed: int = RANDOM_STATE) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def hash_threshold_hex(fraction: float) -> str:
    """Hex prefix bound: ``first8 < bound`` <=> ``int(first8, 16) / 2^32 < fraction``."""
    return format(min(math.ceil(fraction * 2 ** 32), 2 ** 32 - 1), "08x")


def hash_split(df: DataFrame, key: str = "sample_id", test_size: float = TEST_SIZE,
               seed: int = RANDOM_STATE, out: str = "is_test") -> DataFrame:
    return df.withColumn(out, F.substring(row_hash(key, seed), 1, 8) < F.lit(hash_threshold_hex(test_size)))


def _ranked(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    h = df.withColumn("__h", row_hash(key, seed))
    return ordinal_rank(h, ["__h", key], [label], out="__rank")


def stratified_split(df: DataFrame, key: str = "sample_id", label: str = "likely",
                     test_size: float = TEST_SIZE, seed: int = RANDOM_STATE,
                     out: str = "is_test") -> DataFrame:
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row per class
    ranked = _ranked(df, key, label, seed)
    cond = F.lit(False)
    for cls, n in counts.items():
        k = math.ceil(test_size * n)
        match = F.col(label).isNull() if cls is None else (F.col(label) == F.lit(cls))
        cond = F.when(match, F.col("__rank") <= F.lit(k)).otherwise(cond)
    return ranked.withColumn(out, cond).drop("__h", "__rank")


def stratified_folds(df: DataFrame, key: str = "sample_id", label: str = "likely",
                     k: int = CV_FOLDS, seed: int = RANDOM_STATE, out: str = "fold") -> DataFrame:
    ranked = _ranked(df, key, label, seed)
    return ranked.withColumn(out, ((F.col("__rank") - 1) % k).cast("int")).drop("__h", "__rank")


def split(df: DataFrame, flag: str = "is_test"):
    """(train, test) halves of a flagged frame."""
    return df.where(~F.col(flag)).drop(flag), df.where(F.col(flag)).drop(flag)
