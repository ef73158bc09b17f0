"""The model queries end to end, with one small candidate a model: what they
return, not how well the search does."""

import pytest

from tests.conftest import SF0001

SMALL = {"logistic_regression": {"C": [1.0]}, "random_forest": {"n_estimators": [3], "max_depth": [3]}, "extra_trees": {"n_estimators": [3], "max_depth": [3]},
         "gradient_boosting": {"n_estimators": [2], "max_depth": [2]}, "xgboost": {"n_estimators": [2], "max_depth": [2]}}


@pytest.fixture(scope="module")
def run(spark):
    from terrascore.operators import models as M
    from terrascore.plans import queries_model as QM
    from terrascore.plans import training as PL

    kept, vote = dict(M.SEARCH_GRIDS), PL.voted_features
    M.SEARCH_GRIDS.update(SMALL)
    # the vote of six selectors has its own tests
    PL.voted_features = lambda x, cols, label, *a: list(cols)[:8]
    QM._PREP.clear()
    QM._TRAINED.clear()
    yield lambda name: __import__("__spark_entry__").queries()[name](spark, SF0001)
    M.SEARCH_GRIDS.update(kept)
    PL.voted_features = vote
    QM._PREP.clear()
    QM._TRAINED.clear()


def test_training_queries(run):
    ten = [*SMALL, "voting_soft", "voting_hard", "weighted_average", "rank_average", "stacking"]
    report = run("evaluation_report").collect()
    assert {r["model"] for r in report if r["section"] == "metrics"} == set(ten)
    assert [r["value"] for r in report if r["item"] == "total_models"] == [10.0]
    best = next(r for r in report if r["item"] == "best_roc_auc")
    aucs = {r["model"]: r["value"] for r in report if r["item"] == "roc_auc"}
    assert best["value"] == max(aucs.values()) and aucs[best["text"]] == best["value"]
    assert len([r for r in report if r["section"] == "recommendations"]) == 4
    test_rows = run("model_roundtrip").count()
    assert run("stack").count() == run("blend").count() == test_rows and run("train_ensembles").count() == 5 * test_rows
    assert {r["model"] for r in run("model_summary").collect()} == set(SMALL)
    assert run("importance_by_group").where("rank > 20").count() == 0

    scores = run("score_samples").collect()
    assert scores and all(0 <= r["raw_score"] <= 1 and 0.7 <= r["prospectivity_score"] <= 0.95 for r in scores)
    summary = run("pipeline_summary").collect()
    assert len(summary) == 1 and summary[0]["models_trained"] == 10 and summary[0]["samples_scored"] == len(scores)
    texts = {r["item"]: r["text"] for r in run("summary_texts").collect()}
    assert texts["best_model"].startswith(summary[0]["best_model"]) and len(texts) == 6
