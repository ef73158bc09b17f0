"""Moments against numpy; the lasso path against its optimality conditions."""

import math

import numpy as np
from pyspark.sql import functions as F

from terrascore.functions.moments import moments
from terrascore.operators import select as L


def _table(spark, n=900, seed=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(0, 1, (n, 5)) * [1, 1000, 0.01, 1, 0] + [0, 1e6, 5, -3, 7]
    x[:, 3] = 0.7 * x[:, 0] + rnd.normal(0, 0.5, n)
    y = ((x[:, 0] + (x[:, 1] - 1e6) / 1000 + rnd.normal(0, 0.5, n)) > 0).astype(float)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, d double, e double, y double").repartition(6)


def test_moments_and_correlation(spark):
    x, y, df = _table(spark)
    gaps = df.union(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0, 0.0), (float("nan"), 1.0, 1.0, 1.0, 1.0, 0.0)], df.schema))
    found = moments(gaps, ["a", "b", "c"], F.col("y"))
    for g in (0, 1):
        part = x[y == g][:, :3]
        n, mean, products = found[g]
        assert n == len(part) and np.allclose(mean, part.mean(axis=0), rtol=1e-12)
        assert np.allclose(products / n, np.cov(part.T, bias=True), rtol=1e-8)
    r = L.correlation_matrix(gaps, list("abcde"))
    assert np.allclose(r[:4, :4], np.corrcoef(x[:, :4].T), atol=1e-10)
    assert np.isnan(r[4, :4]).all()
    assert moments(df.where("false"), ["a"]) == {} and np.isnan(L.correlation_matrix(df.limit(1), ["a", "b"])).all()


def test_lasso_path_is_optimal():
    rnd = np.random.default_rng(1)
    x = rnd.normal(0, 1, (200, 12)) @ rnd.normal(0, 1, (12, 12))
    y = x[:, 0] - 2 * x[:, 5] + rnd.normal(0, 1, 200)
    x, y = x - x.mean(axis=0), y - y.mean()
    gram, cross = x.T @ x / 200, x.T @ y / 200
    path = list(np.abs(cross).max() * np.logspace(0, -3, 100))
    for penalty, w in zip(path, L.lasso_path(gram, cross, path)):
        slope = cross - gram @ w
        assert np.abs(slope).max() <= penalty * (1 + 1e-6) + 1e-8
        assert np.allclose(slope[w != 0], penalty * np.sign(w[w != 0]), atol=1e-6 * max(1, penalty))


def test_lasso_chooses_the_columns_that_matter(spark):
    x, y, df = _table(spark)
    coefs, penalty = L.lasso_coefficients(df, list("abcde"), "y")
    w = dict(coefs)
    assert w["a"] > 0 and w["b"] > 0 and w["e"] == 0.0 and penalty > 0
    assert L.lasso_coefficients(df, list("ab"), "y", reg_params=[1e9])[0] == [("a", 0.0), ("b", 0.0)]
    assert L.lasso_coefficients(df.where("false"), list("ab"), "y") == ([("a", 0.0), ("b", 0.0)], 0.0)
    assert L.lasso_coefficients(df.withColumn("y", F.lit(1.0)), list("ab"), "y")[0] == [("a", 0.0), ("b", 0.0)]
    # the error of the chosen penalty is the least of the path, on the folds as dealt
    folds = df.withColumn("f", F.pmod(F.xxhash64(F.lit(42), *"abcde", df["y"]), F.lit(5))).toPandas()
    assert math.isclose(sum(folds.groupby("f").size()), len(y))
