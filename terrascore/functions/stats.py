"""Fitted statistics, gathered in as few passes as possible.

Everything returned here is bounded by (#columns x #probabilities), never
by the row count, so it is safe to bring to the driver.

Exact quantiles do not use the global ``percentile`` aggregate, which
keeps one value->count map for the whole table in a single final task, nor
do they shuffle the values.  They are found by selection, all columns (and groups) in
the same jobs:

1. a mergeable sketch of each column gives a bracket of values around each
   wanted rank,
2. a counting pass gives every value its slot: a bracket or a gap between
   brackets.  Values in gaps are only counted, the few in brackets are counted
   by value.  Without groups a task counts whole Arrow batches of columns, so a
   row is not copied once a column; with groups there is a row a value and
   Spark combines them in the task,
3. the counts tell whether each rank lies in its bracket.  A bracket that
   missed is widened and the pass repeated; the others hold the values of
   their ranks.

Interpolation is ``lo + (hi - lo) * frac`` at position ``p * (n - 1)``,
i.e. ``quantile_cont`` / pandas ``quantile`` semantics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: relative accuracy of the sketch: a bracket holds about 4 in ACCURACY of the values
ACCURACY = 1000


def one_pass(df: DataFrame, aggs: dict[str, F.Column]) -> dict:
    """Run named aggregates in one job and return them as a dict."""
    if not aggs:
        return {}
    row = df.agg(*[c.alias(k) for k, c in aggs.items()]).collect()[0]
    return row.asDict()


def means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return one_pass(df, {c: F.avg(F.col(c).cast("double")) for c in cols})


def null_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Missing values per column (NULL, and NaN in float columns)."""
    def missing(c):
        dt = df.schema[c].dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            return F.col(c).isNull() | F.isnan(c)
        return F.col(c).isNull()
    return one_pass(df, {c: F.count_if(missing(c)) for c in cols})


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of every column, NULL and NaN ignored.

    Returns ``{col: [q(p) for p in probs]}``; an all-NULL column gives
    ``None`` for every p.
    """
    cols = list(cols)
    if not cols:
        return {}
    found = _select_quantiles(df.select(F.lit(0).alias("g"), *_doubles(df, cols)), cols, probs, accuracy, grouped=False)
    return {c: found.get((0, c), [None] * len(probs)) for c in cols}


def grouped_quantiles(df: DataFrame, group_col: str, cols: Sequence[str], probs: Sequence[float],
                      accuracy: int = ACCURACY) -> dict[tuple, list[float | None]]:
    """Exact quantiles per (group, column): ``{(group, col): [...]}``, without
    the groups that have no value.

    The result -- and the brackets on the way -- hold one entry per
    (group, column), so ``group_col`` must be a bounded category (bands,
    top-k levels)."""
    cols = list(cols)
    return _select_quantiles(df.select(F.col(group_col).alias("g"), *_doubles(df, cols)), cols, probs, accuracy)


def _doubles(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """The columns as doubles c0, c1, ...; NaN counts as missing."""
    return [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(cols)]


def _merge(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _slots(df: DataFrame, n: int, brackets: dict[tuple, list[tuple[float, float]]]) -> DataFrame:
    """(g, c0, ...) -> g, k (number of the column), slot, v: one row per value.
    Bracket j is slot 2j + 1 and keeps its value, the gap before it slot 2j."""
    groups = {g for g, _ in brackets}
    edges = df.sparkSession.createDataFrame(
        [(g, [[b[e] for b in brackets.get((g, i), [])] for i in range(n) for e in (0, 1)]) for g in sorted(groups, key=str)],
        T.StructType([T.StructField("g", df.schema["g"].dataType), T.StructField("e", T.ArrayType(T.ArrayType(T.DoubleType())))]))
    edges = edges.select(F.col("g").alias("_g"), "e")
    df = df.join(F.broadcast(edges), F.col("g").eqNullSafe(F.col("_g")))  # a row a group

    def slot(i):
        v = F.col(f"c{i}")
        return (F.size(F.filter(F.col("e")[2 * i], lambda x: v >= x)) + F.size(F.filter(F.col("e")[2 * i + 1], lambda x: v > x)))

    wide = df.select("g", *[F.struct(F.lit(i).alias("k"), slot(i).alias("slot"), F.col(f"c{i}").alias("v")).alias(f"s{i}") for i in range(n)])
    each = wide.select("g", F.inline(F.array(*[f"s{i}" for i in range(n)]))).where("v IS NOT NULL")
    return each.select("g", "k", "slot", F.when(F.col("slot") % 2 == 1, F.col("v")).alias("v"))


def _counts(df: DataFrame, n: int, brackets: dict[tuple, list[tuple[float, float]]], grouped: bool) -> DataFrame:
    """(g, k, slot, v, n): values by slot, those in brackets by value."""
    if grouped:
        return _slots(df, n, brackets).groupBy("g", "k", "slot", "v").agg(F.count(F.lit(1)).alias("n"))
    # the columns that are looked at, with the lower and the upper ends of their brackets
    ends = [(i, np.array([lo for lo, _ in b]), np.array([hi for _, hi in b])) for (_, i), b in sorted(brackets.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = [np.zeros(2 * len(lo) + 1, np.int64) for _, lo, _ in ends]

        def made(k, slot, v, n):
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(slot, pa.int32()), pa.array(v, pa.float64()), pa.array(n, pa.int64())],
                                              names=["k", "slot", "v", "n"])

        for batch in batches:
            found = []
            for at, (i, lo, hi) in enumerate(ends):
                v = batch.column(at).to_numpy(zero_copy_only=False)
                v = v[~np.isnan(v)] + 0.0  # no NULL, one zero
                slot = np.searchsorted(lo, v, "right") + np.searchsorted(hi, v, "left")
                gaps[at] += np.bincount(slot, minlength=len(gaps[at]))
                values, counts = np.unique(v[slot % 2 == 1], return_counts=True)
                found.append((np.full(len(values), i), np.searchsorted(lo, values, "right") + np.searchsorted(hi, values, "left"), values, counts))
            yield made(*[np.concatenate(c) for c in zip(*found)])
        for (i, _, _), own in zip(ends, gaps):
            slot = np.arange(0, len(own), 2)  # values in brackets have gone out
            yield made(np.full(len(slot), i), slot, [None] * len(slot), own[slot])

    parts = df.select(*[f"c{i}" for i, _, _ in ends]).mapInArrow(run, "k int, slot int, v double, n long").where("n > 0")
    return parts.groupBy(F.lit(0).alias("g"), "k", "slot", "v").agg(F.sum("n").alias("n"))


def _select_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int,
                      grouped: bool = True) -> dict[tuple, list[float | None]]:
    """(g, c0, c1, ...) -> {(g, column): quantiles}; ``grouped=False`` says that g is 0 in all rows."""
    n, probs = len(cols), [float(p) for p in probs]
    if not n or not probs:
        return {}
    # an error of 1 / accuracy of the ranks on either side, twice over
    wide = 2.0 / accuracy
    around = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-wide, wide)})
    asked = F.array(*[F.lit(p) for p in around])
    rows = df.groupBy("g").agg(*[x for i in range(n) for x in (
        F.count(f"c{i}").alias(f"n{i}"), F.percentile_approx(f"c{i}", asked, accuracy).alias(f"q{i}"),
        F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}"))]).collect()  # one row a group
    totals = {(r["g"], i): r[f"n{i}"] for r in rows for i in range(n) if r[f"n{i}"]}
    sketch = {(r["g"], i): dict(zip(around, r[f"q{i}"])) for r in rows for i in range(n) if r[f"n{i}"]}
    ends = {(r["g"], i): (r[f"lo{i}"], r[f"hi{i}"]) for r in rows for i in range(n) if r[f"n{i}"]}
    wanted = {key: sorted({r for p in probs for r in (math.floor(p * (m - 1)), min(math.floor(p * (m - 1)) + 1, m - 1))})
              for key, m in totals.items()}

    def bracket(key, p):
        lo, hi = (sketch[key][min(1.0, max(0.0, p + d))] for d in (-wide, wide))
        return (ends[key][0] if p - wide <= 0 else lo), (ends[key][1] if p + wide >= 1 else hi)

    brackets = {key: _merge([bracket(key, p) for p in probs]) for key in totals}
    values: dict[tuple, float] = {}
    left = dict(wanted)
    while left:
        counts = _counts(df, n, {key: brackets[key] for key in left}, grouped).persist()
        try:
            sums = {(r["g"], r["k"], r["slot"]): r["n"] for r in counts.groupBy("g", "k", "slot").agg(F.sum("n").alias("n")).collect()}
            targets, again = [], {}
            for key, ranks in left.items():
                before = 0
                for slot in range(2 * len(brackets[key]) + 1):
                    own = sums.get((*key, slot), 0)
                    for r in (r for r in ranks if before <= r < before + own):
                        if slot % 2:
                            targets.append((*key, slot, r - before, r))
                        else:
                            again.setdefault(key, []).append(r)
                    before += own
            if targets:
                # a bracket holds a small share of the values, each once: a task a bracket
                run = Window.partitionBy("g", "k", "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
                cum = counts.where("v IS NOT NULL").withColumn("upto", F.sum("n").over(run))
                table = df.sparkSession.createDataFrame(targets, T.StructType([
                    T.StructField("_g", df.schema["g"].dataType), T.StructField("_k", T.IntegerType()), T.StructField("_slot", T.IntegerType()),
                    T.StructField("_r", T.LongType()), T.StructField("rank", T.LongType())]))
                hit = cum.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("_g")) & (F.col("k") == F.col("_k")) & (F.col("slot") == F.col("_slot"))
                               & (F.col("upto") - F.col("n") <= F.col("_r")) & (F.col("_r") < F.col("upto")))
                values.update({(r["g"], r["k"], r["rank"]): r["v"] for r in hit.select("g", "k", "rank", "v").collect()})
        finally:
            counts.unpersist()
        # a rank in a gap: its neighbours' brackets reach over the gap
        for key in again:
            lo, hi = ends[key]
            edge = [lo, *[x for b in brackets[key] for x in b], hi]
            brackets[key] = _merge([(edge[max(0, 2 * j - 1)], edge[min(len(edge) - 1, 2 * j + 2)]) for j in range(len(brackets[key]) + 1)])
        left = again

    def quantile(key, p):
        pos = p * (totals[key] - 1)
        at = math.floor(pos)
        a, b = values[(*key, at)], values[(*key, min(at + 1, totals[key] - 1))]
        return a if pos == at or a == b else a + (b - a) * (pos - at)

    return {(g, cols[i]): [quantile((g, i), p) for p in probs] for g, i in totals}


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    q = exact_quantiles(df, cols, [0.5])
    return {c: q[c][0] for c in cols}


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     accuracy: int = 100000) -> dict[str, list[float | None]]:
    """Single-pass sketch (``percentile_approx``) for when exactness is not needed."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    row = one_pass(df, {c: F.percentile_approx(F.col(c).cast("double"), arr, accuracy) for c in cols})
    return {c: (list(row[c]) if row[c] is not None else [None] * len(probs)) for c in cols}


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], exact: bool = True):
    return exact_quantiles(df, cols, probs) if exact else approx_quantiles(df, cols, probs)
