"""Counting passes of the quantiles and of mutual information: the counts, and
that no row is copied once a column."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from terrascore.functions import stats
from terrascore.operators import select as L

NAN, INF = float("nan"), float("inf")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bins_by_label(spark):
    rnd = np.random.default_rng(3)
    a, b = rnd.normal(0, 1, 400), rnd.integers(0, 4, 400)
    y = [None if i % 41 == 0 else int(v > 0) for i, v in enumerate(a)]
    rows = [(None if i % 29 == 0 else NAN if i % 31 == 0 else float(p), int(q), None, z) for i, (p, q, z) in enumerate(zip(a, b, y))]
    rows += [(INF, 0, None, 1), (-INF, 0, None, 0), (-0.0, 3, None, 1)]
    df = spark.createDataFrame(rows, "a double, b int, e double, y int").repartition(5)
    edges = {"a": [-0.5, 0.0, 0.5], "b": [1.0, 1.0, 2.0], "e": [None, None, None]}
    counts = L.bin_counts(df, ["a", "b", "e"], "y", edges)
    expected = Counter()
    for *values, z in rows:
        for c, v in zip("abe", values):
            expected[c, 0 if v is None else sum(math.isnan(v) or v > x for x in edges[c] if x is not None), z] += 1
    assert {(r["feature"], r["bin"], r["__y"]): r["n"] for r in counts.collect()} == dict(expected)
    assert "Generate" not in _plan(counts)
    # the scores read the counts that were written, not the rows again
    assert "MapInArrow" not in _plan(L.mi_scores(df, ["a", "b", "e"], "y", edges=edges))
    text = df.withColumn("y", F.when(F.col("y") == 1, "yes").when(F.col("y") == 0, "no"))
    assert ({r["feature"]: r["score"] for r in L.mi_scores(text, ["a", "b"], "y", edges=edges).collect()}
            == {r["feature"]: r["score"] for r in L.mi_scores(df, ["a", "b"], "y", edges=edges).collect()})
    assert L.mi_scores(df.where("false"), ["a", "b"], "y", edges=edges).count() == 0


def test_counts_by_slot(spark):
    rows = [(0, float(i % 10), None if i % 3 else -0.0) for i in range(100)] + [(0, None, 0.0), (0, NAN, 5.0)]
    raw = spark.createDataFrame(rows, "g int, c0 double, c1 double").repartition(4)
    df = raw.select("g", *stats._doubles(raw, ["c0", "c1"]))
    found = stats._counts(df, 2, {(0, 0): [(2.0, 3.0), (7.0, 7.0)], (0, 1): [(0.0, 0.0)]}, grouped=False)
    got = {(r["k"], r["slot"], r["v"]): r["n"] for r in found.collect()}
    assert got == {(0, 0, None): 20, (0, 1, 2.0): 10, (0, 1, 3.0): 10, (0, 2, None): 30, (0, 3, 7.0): 10, (0, 4, None): 20,
                   (1, 1, 0.0): 35, (1, 2, None): 1}
    by_value = stats._counts(df, 2, {(0, 0): [(2.0, 3.0), (7.0, 7.0)], (0, 1): [(0.0, 0.0)]}, grouped=True)
    assert {(r["k"], r["slot"], r["v"]): r["n"] for r in by_value.collect()} == got
    assert "Generate" not in _plan(found)
