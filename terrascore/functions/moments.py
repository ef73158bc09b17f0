"""Counts, means and centred cross-products of columns, in one pass.

Each task sums its rows as they come, batch by batch, with the pairwise
update for centred products, so nothing cancels where means are large
beside spreads.  The tasks' results (one p x p matrix a group) are merged
on executors first, so that the driver merges about the root of their
number, however many tasks read the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(a: tuple, b: tuple) -> tuple:
    """(n, means, centred products) of two sets of rows together."""
    (n, m, s), (k, o, t) = a, b
    if not n or not k:
        return b if not n else a
    gap = o - m
    return n + k, m + gap * (k / (n + k)), s + t + np.outer(gap, gap) * (n * k / (n + k))


def _of(x: np.ndarray) -> tuple:
    mean = x.mean(axis=0)
    c = x - mean
    return len(x), mean, c.T @ c


def _emit(found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int64()), pa.array([n for n, _, _ in found.values()], pa.int64()),
         pa.array([m for _, m, _ in found.values()], pa.list_(pa.float64())),
         pa.array([s.ravel() for _, _, s in found.values()], pa.list_(pa.float64()))], names=["g", "n", "mean", "products"])


def moments(df: DataFrame, cols: Sequence[str], group: F.Column | None = None) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """{group: (rows, means, p x p centred products)} over the rows that are
    complete in ``cols`` (no NULL, no NaN).  ``group`` is a whole number of
    few values (0 if not given); a group without complete rows is missing."""
    cols, p = list(cols), len(cols)
    g = (F.lit(0) if group is None else group).cast("long")
    x = df.select(g.alias("_g"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            if batch.num_rows:
                at = batch.column(0).to_numpy(zero_copy_only=False)
                rows = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(p)])
                for k in np.unique(at):
                    new = _of(rows[at == k])
                    found[int(k)] = merged(found[int(k)], new) if int(k) in found else new
        if found:
            yield _emit(found)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for k, n, mean, products in zip(*(c.to_pylist() for c in batch.columns)):
                new = n, np.array(mean), np.array(products).reshape(p, p)
                found[k] = merged(found[k], new) if k in found else new
        if found:
            yield _emit(found)

    schema = "g long, n long, mean array<double>, products array<double>"
    parts = x.mapInArrow(gather, schema)
    few = max(1, math.isqrt(df.sparkSession.sparkContext.defaultParallelism))
    out: dict = {}
    for r in parts.repartition(few).mapInArrow(fold, schema).collect():  # a row a group from each of ``few`` tasks
        new = r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(p, p)
        out[r["g"]] = merged(out[r["g"]], new) if r["g"] in out else new
    return out
