"""Planted-signal model checks, stacking/streaming smoke and the driver contract."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001


@pytest.fixture(scope="module")
def prep(spark):
    from terrascore.config import TESTDATA
    from terrascore.plans.training import prepare_training
    from terrascore.sources.fixtures import samples
    return prepare_training(samples(spark, SF0001), TESTDATA, select=False, folds=3)


def test_planted_signal_models(spark, prep):
    from terrascore.operators import metrics as T
    from terrascore.operators import models as M

    for name, grid in [("logistic_regression", {"C": [1.0]}),
                       ("random_forest", {"n_estimators": [10], "max_depth": [5]}),
                       ("gradient_boosting", {"n_estimators": [10], "max_depth": [3]})]:
        t = M.tune_model(prep.train, name, grid, folds=3)
        auc = T.roc_auc(M.predict_long(t.model, prep.test, name)).first()["roc_auc"]
        assert auc > 0.85, (name, auc)
        assert t.cv_score > 0.85


def test_grid_sampling_and_params():
    from terrascore.config import HYPERPARAMETERS
    from terrascore.operators import models as M

    combos = M.grid_combinations(HYPERPARAMETERS["xgboost"])
    assert len(combos) == 50 and len({tuple(sorted(c.items())) for c in combos}) == 50
    assert M.spark_params("random_forest", {"max_depth": None})["maxDepth"] == 30
    assert math.isclose(M.spark_params("logistic_regression", {"C": 0.1}, 100)["regParam"], 0.1)


def test_stratified_folds_present(prep):
    assert sorted(r[0] for r in prep.train.select("fold").distinct().collect()) == [0, 1, 2]


def test_stream_scoring_matches_batch(spark, prep):
    import tempfile
    from terrascore.operators import models as M
    from terrascore.plans.training import prepare_scoring, score_table
    from terrascore.sources.fixtures import samples
    from terrascore.streaming.scoring import start_scoring_stream

    model = M.estimator("logistic_regression").fit(prep.train)
    root = tempfile.mkdtemp(prefix="stream-")
    s = samples(spark, SF0001)
    s.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    q = start_scoring_stream(stream, prep.state, model, f"{root}/out", f"{root}/ck")
    q.awaitTermination()
    got = spark.read.parquet(f"{root}/out")
    exp = score_table(model, prepare_scoring(s, prep.state))
    j = got.join(exp.select("sample_id", F.col("raw_score").alias("e")), "sample_id")
    assert got.count() == s.count() == j.count()
    assert j.where(F.abs(F.col("raw_score") - F.col("e")) > 1e-12).count() == 0


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


def test_planted_features_lead_mutual_information(spark):
    """The target is planted on price_max (q2) and quantity sum (q1)."""
    from pyspark.sql import functions as F
    from terrascore.operators import select as L
    from terrascore.plans.queries_select import FEATS, features_frame

    s = L.mi_scores(features_frame(spark, SF0001), FEATS, "likely")
    top = [r["feature"] for r in L.top_k(s, 4).orderBy("rank").collect()]
    assert "q2" in top and "q1" in top, top


def test_search_uses_the_reference_grids(monkeypatch):
    from terrascore.operators import models as M
    from terrascore.plans import queries_model as QM
    from terrascore.plans import queries_score as QS

    seen = {}

    def tune(train, name, grid=None, **kw):
        seen[name] = len(M.grid_combinations(grid, settings=lambda c: M.spark_params(name, c, 100)))
        return M.Tuned(name, None, 0.0)

    class Table:
        is_cached = True

    class Prepared:
        train = test = Table()

    monkeypatch.setattr(M, "tune_model", tune)
    monkeypatch.setattr(M, "predict_long", lambda model, test, name: Table())
    Table.unionByName = lambda self, other: self
    monkeypatch.setattr(QM, "prepared", lambda spark, sf: Prepared())
    want = {"logistic_regression": 5, "random_forest": 50, "extra_trees": 50, "gradient_boosting": 50, "xgboost": 50}
    M.train_all(Table(), Table())
    assert seen == want
    for name in list(seen):
        seen.clear()
        QM._single(name)(None, "")
        assert seen == {name: want[name]}
    assert QS.G == 200
