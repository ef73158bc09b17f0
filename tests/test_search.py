"""The model search: fits are shared, scores are those of direct fits."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from terrascore.operators import models as M


@pytest.fixture(scope="module")
def train(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(0, 1, (400, 4))
    y = (x[:, 0] + x[:, 1] ** 2 + rnd.normal(0, 0.7, 400) > 1).astype(float)
    rows = [(i, list(map(float, a)), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "sample_id long, f array<double>, label double, fold int")
    return df.select("sample_id", array_to_vector("f").alias("features"), "label", "fold").coalesce(1).cache()


def _direct(train, name, params, folds=3):
    """Mean held-out AUC of fits of their own."""
    ev, out = BinaryClassificationEvaluator(numBins=0), []
    for f in range(folds):
        est = M.estimator(name)
        m = est.copy({est.getParam(k): v for k, v in params.items()}).fit(train.where(F.col("fold") != f))
        out.append(ev.evaluate(m.transform(train.where(F.col("fold") == f))))
    return sum(out) / folds


def test_plan_shares_fits():
    grid = M.SEARCH_GRIDS["gradient_boosting"]
    combos = M.grid_combinations(grid, settings=lambda c: M.spark_params("gradient_boosting", c, 100))
    plan = M.fit_plan("gradient_boosting", [M.spark_params("gradient_boosting", c, 100) for c in combos])
    assert len(combos) == 50 and len(plan) <= 27
    assert sorted(i for _, members in plan for i, _ in members) == list(range(50))
    assert all(p["maxIter"] == max(k for _, k in members) for p, members in plan)
    assert M.fit_plan("logistic_regression", [{"regParam": 1.0}, {"regParam": 2.0}]) == [({"regParam": 1.0}, [(0, None)]), ({"regParam": 2.0}, [(1, None)])]
    mixed = M.fit_plan("random_forest", [{"numTrees": 5}, {}, {"numTrees": 9}])
    assert sorted(i for _, m in mixed for i, _ in m) == [0, 1, 2] and len(mixed) == 3


def test_boosted_candidates_score_like_direct_fits(train, monkeypatch):
    grid = {"n_estimators": [2, 4, 7], "max_depth": [2], "learning_rate": [0.3, 0.1], "subsample": [0.7]}
    fits, real = [], M.GBTClassifier._fit
    monkeypatch.setattr(M.GBTClassifier, "_fit", lambda self, data: (fits.append(self.getMaxIter()), real(self, data))[1])
    t = M.tune_model(train, "gradient_boosting", grid, folds=3)
    assert sorted(fits[:-1]) == [7] * 6  # two learning rates, three folds; then the refit
    combos = M.grid_combinations(grid)
    scores = [_direct(train, "gradient_boosting", M.spark_params("gradient_boosting", c)) for c in combos]
    assert abs(max(scores) - t.cv_score) < 1e-9
    assert t.best_params == combos[int(np.argmax(scores))]
    held = t.held_out.orderBy("sample_id").collect()
    assert [r["sample_id"] for r in held] == list(range(400)) and all(r["fold"] == r["sample_id"] % 3 for r in held)


def test_forest_prefix_and_logistic(train):
    rf = M.RandomForestClassifier(numTrees=6, maxDepth=3, seed=1).fit(train)
    part = M.first_trees(rf, 4)
    assert len(part.trees) == 4 and M.first_trees(rf, 6) is rf
    votes = [t.transform(train.select("features")).select(vector_to_array("probability")[1].alias("p")).toPandas()["p"].to_numpy() for t in rf.trees[:4]]
    got = part.transform(train).select(vector_to_array("probability")[1].alias("p")).toPandas()["p"].to_numpy()
    assert np.allclose(got, np.mean(votes, axis=0), atol=1e-9)
    t = M.tune_model(train.drop("fold"), "logistic_regression", {"C": [0.1, 1.0]}, folds=3)
    assert t.held_out.count() == 400 and t.cv_score > 0.5


def test_stacking_needs_no_fits_after_a_search(train, monkeypatch):
    tuned = {n: M.tune_model(train, n, g, folds=3) for n, g in (("logistic_regression", {"C": [1.0]}), ("random_forest", {"n_estimators": [3, 5], "max_depth": [3]}))}
    kept = M.stack(train, train, tuned, k=3).orderBy("sample_id").collect()
    fits, real = [], M.RandomForestClassifier._fit
    monkeypatch.setattr(M.RandomForestClassifier, "_fit", lambda self, data: (fits.append(1), real(self, data))[1])
    M.stack(train, train, tuned, k=3).collect()
    assert not fits
    for t in tuned.values():
        t.held_out = None
    again = M.stack(train, train, tuned, k=3).orderBy("sample_id").collect()
    assert len(fits) == 3 and len(kept) == len(again) == 400
    # the logistic member is the same either way; the forest's trees are drawn alike, not the same
    assert np.corrcoef([r["probability"] for r in kept], [r["probability"] for r in again])[0, 1] > 0.95
