"""M1-M9 (+ N3 stacking, N7 blending): classifiers on Spark ML.

Each model is a Spark ML estimator over an assembled ``features`` vector
and a double ``label``; training, cross-validation folds and prediction
are distributed.  Predictions come out in the long shape shared with the
ensembles and metrics: ``(sample_id, model, type, y, probability,
prediction)``.

Search grids keep the reference's parameter names; ``spark_params``
translates them.  A grid with more than ``MAX_GRID_COMBINATIONS``
combinations is sampled (seeded, without replacement), as the reference
does.  Cross-validation uses an explicit, class-balanced fold column
(``sample.stratified_folds``) and exact ROC-AUC.

Candidates that differ only in their number of trees are one fit a fold:
the longest ensemble is grown, and its first trees are the shorter ones.
(Boosted trees are the same as in a fit of that length; a forest's are drawn
alike.)  Held-out predictions of all candidates and folds go to one long
table, whose AUCs come from one pass; the winner's are kept, so stacking
needs no fits of its own.
"""

from __future__ import annotations

import itertools
import json
import random
import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrascore.config import (EXTRA_TREES_GRID, GRADIENT_BOOSTING_GRID,
                               HYPERPARAMETERS, MAX_GRID_COMBINATIONS, RANDOM_STATE)
from terrascore.operators.extratrees import ExtraTreesClassifier, limited
from terrascore.operators.logistic import fit_side_by_side
from terrascore.operators.metrics import roc_auc
from terrascore.session import checkpoint_root, materialize

MODEL_NAMES = ["logistic_regression", "random_forest", "extra_trees", "gradient_boosting", "xgboost"]
MAX_TREE_DEPTH = 30  # deepest tree Spark grows; stands for "no limit"

# What the reference's training code searches: its config grids, with grids
# of its own for extra trees and gradient boosting.
SEARCH_GRIDS = {**HYPERPARAMETERS, "extra_trees": EXTRA_TREES_GRID, "gradient_boosting": GRADIENT_BOOSTING_GRID}


def _depth(v):
    return MAX_TREE_DEPTH if v is None else min(int(v), MAX_TREE_DEPTH)


def spark_params(name: str, p: Mapping, n_rows: int | None = None) -> dict:
    """Translate one reference parameter combination into estimator params.
    Parameters without a Spark counterpart (solver, a forest's
    min_samples_split, reg_alpha, reg_lambda) are dropped."""
    out: dict = {}
    if name == "logistic_regression":
        c = float(p.get("C", 1.0))
        out["regParam"] = 1.0 / (c * max(n_rows or 1, 1))
        if "max_iter" in p:
            out["maxIter"] = int(p["max_iter"])
    elif name in ("random_forest", "extra_trees"):
        if "n_estimators" in p:
            out["numTrees"] = int(p["n_estimators"])
        if "max_depth" in p:
            out["maxDepth"] = _depth(p["max_depth"])
        if "min_samples_leaf" in p:
            out["minInstancesPerNode"] = int(p["min_samples_leaf"])
        if "max_features" in p:
            out["featureSubsetStrategy"] = str(p["max_features"])
        if "min_samples_split" in p and name == "extra_trees":
            out["minSamplesSplit"] = int(p["min_samples_split"])
    elif name in ("gradient_boosting", "xgboost"):
        if "n_estimators" in p:
            out["maxIter"] = int(p["n_estimators"])
        if "learning_rate" in p:
            out["stepSize"] = float(p["learning_rate"])
        if "max_depth" in p:
            out["maxDepth"] = _depth(p["max_depth"])
        if "subsample" in p:
            out["subsamplingRate"] = float(p["subsample"])
        if "colsample_bytree" in p:
            out["featureSubsetStrategy"] = str(float(p["colsample_bytree"]))
    return out


def estimator(name: str, seed: int = RANDOM_STATE):
    """M1-M5 base estimators."""
    if name == "logistic_regression":
        # tol: the reference solver's default stopping tolerance
        return LogisticRegression(maxIter=100, tol=1e-4, elasticNetParam=0.0, standardization=False)
    if name == "random_forest":
        return RandomForestClassifier(seed=seed)
    if name == "extra_trees":
        return ExtraTreesClassifier(seed=seed, featureSubsetStrategy="sqrt")
    if name == "gradient_boosting":
        return GBTClassifier(seed=seed)
    if name == "xgboost":
        return GBTClassifier(seed=seed, featureSubsetStrategy="0.8")
    raise ValueError(name)


def grid_combinations(grid: Mapping[str, Sequence], n_iter: int = MAX_GRID_COMBINATIONS,
                      seed: int = RANDOM_STATE, settings=None) -> list[dict]:
    """Full grid, or ``n_iter`` combinations sampled without replacement.
    Of combinations that ``settings`` maps to the same value the first stays."""
    keys = list(grid)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    if settings is not None:
        first: dict = {}
        for c in combos:
            first.setdefault(json.dumps(settings(c), sort_keys=True), c)
        combos = list(first.values())
    if len(combos) > n_iter:
        combos = random.Random(seed).sample(combos, n_iter)
    return combos


def assemble(df: DataFrame, features: Sequence[str], label: str = "likely",
             keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    out = va.transform(df)
    cols = [F.col(k) for k in keep if k in df.columns] + [F.col("features")]
    if label in df.columns:
        cols.append(F.col(label).cast("double").alias("label"))
    if "fold" in df.columns:
        cols.append(F.col("fold"))
    return out.select(*cols)


@dataclass
class Tuned:
    name: str
    model: object
    cv_score: float
    best_params: dict = field(default_factory=dict)
    spark_params: dict = field(default_factory=dict)
    #: (sample_id, fold, y, probability): each training row by the fit that left its fold out
    held_out: DataFrame | None = None

    def fresh(self):
        """An unfitted estimator with the chosen parameters (for refits)."""
        est = estimator(self.name)
        return est.copy({est.getParam(k): v for k, v in self.spark_params.items()})


@contextmanager
def cached(df: DataFrame):
    """``df`` persisted while in use; one that its caller persists already is left to the caller."""
    own = not df.is_cached
    if own:
        df.persist()
    try:
        yield df
    finally:
        if own:
            df.unpersist()


#: the parameter that is an ensemble's number of trees
LENGTH = {"random_forest": "numTrees", "extra_trees": "numTrees", "gradient_boosting": "maxIter", "xgboost": "maxIter"}
#: limits of a fit that are also limits on a fit that goes beyond them, and how to go beyond all of some
LIMITS = {"extra_trees": {"maxDepth": max, "minSamplesSplit": min}}
#: logistic regressions of this many rows are fitted side by side; smaller tables' one by one, so that their last digits stay
TOGETHER_ROWS = 100_000
#: a task of a fit reads this many rows at least
ROWS_PER_TASK = 20_000


def first_trees(model, k: int):
    """The ensemble of the first ``k`` trees of a fitted forest or boosted model."""
    fitted = model._java_obj
    if k >= len(fitted.trees()):
        return model
    sc = SparkContext._active_spark_context
    gateway, ml = sc._gateway, sc._jvm.org.apache.spark.ml
    boosted = isinstance(model, GBTClassificationModel)
    kind = ml.regression.DecisionTreeRegressionModel if boosted else ml.classification.DecisionTreeClassificationModel
    trees, grown = gateway.new_array(kind, k), fitted.trees()
    for i in range(k):
        trees[i] = grown[i]
    if not boosted:
        return RandomForestClassificationModel(ml.classification.RandomForestClassificationModel(
            fitted.uid(), trees, fitted.numFeatures(), fitted.numClasses()))
    weights, given = gateway.new_array(sc._jvm.double, k), fitted.treeWeights()
    for i in range(k):
        weights[i] = given[i]
    return GBTClassificationModel(ml.classification.GBTClassificationModel(fitted.uid(), trees, weights, fitted.numFeatures(), fitted.numClasses()))


def fit_plan(name: str, settings: Sequence[Mapping]) -> list[tuple[dict, list[tuple[int, int | None]]]]:
    """Parameters of the fits that a fold needs, each with the candidates (and
    their numbers of trees) that it serves.

    Extra trees' draws depend on the seed and the node alone, so a fit to the
    largest depth and the smallest ``minSamplesSplit`` serves the others as well."""
    length, groups = LENGTH.get(name), {}
    given = [{k for k in LIMITS.get(name, ()) if k in p} for p in settings]
    shared = set.intersection(*given) if given else set()
    for i, p in enumerate(settings):
        rest = {k: v for k, v in p.items() if k != length and k not in shared}
        groups.setdefault(json.dumps(rest, sort_keys=True), (rest, []))[1].append((i, p.get(length)))
    plan = []
    for rest, members in groups.values():
        named = [k for _, k in members if k is not None]
        if named and len(named) < len(members):  # a default length among given ones: fits of their own
            plan += [({**rest, **({length: k} if k else {})}, [(i, k)]) for i, k in members]
        else:
            plan.append(({**rest, length: max(named)} if named else rest, members))
    if shared:
        plan = [({**rest, **{k: LIMITS[name][k](settings[i][k] for i, _ in members) for k in shared}}, members) for rest, members in plan]
    return plan


def served(fitted, name: str, params: Mapping, wanted: Mapping, spark, made: dict):
    """The fit of ``params`` within the limits that a candidate wants; ``made`` keeps those of one fit."""
    own = tuple(wanted.get(k) for k in LIMITS.get(name, ()))
    if all(params.get(k) == v for k, v in zip(LIMITS.get(name, ()), own)):
        return fitted
    if own not in made:
        made[own] = limited(fitted, spark, *own)
    return made[own]


def cross_validate(train: DataFrame, name: str, settings: Sequence[Mapping], fold_col: str = "fold", folds: int = 5,
                   parallelism: int = 4, seed: int = RANDOM_STATE, together: bool = False) -> tuple[list[float], DataFrame, dict]:
    """Mean held-out AUC of each candidate, the written long table
    (candidate, fold, sample_id, y, probability) that it comes from, and those
    candidates' fits on all rows that came along with the folds' (``together``,
    for logistic regressions)."""
    spark = train.sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/held-out-{uuid.uuid4().hex}"
    key = F.col("sample_id") if "sample_id" in train.columns else F.lit(None).cast("long").alias("sample_id")

    side = fit_side_by_side(train, estimator(name, seed), settings, fold_col, folds) if together else None

    def job(task):
        number, (fold, (params, members)) = task
        if side is None:
            est = estimator(name, seed)
            if name in LIMITS:
                est.keep_grown = True
            fitted = est.copy({est.getParam(k): v for k, v in params.items()}).fit(train.where(F.col(fold_col) != fold))
        out = train.where(F.col(fold_col) == fold)
        scored, made = [], {}
        for i, k in members:
            m = side[i, fold] if side is not None else served(fitted, name, params, settings[i], spark, made)
            m = first_trees(m, k) if k is not None else m
            raw, column = m.getRawPredictionCol(), f"p{i}"
            out = (m.copy({m.probabilityCol: column, m.predictionCol: f"c{i}", m.rawPredictionCol: f"{raw}{i}"}).transform(out))
            scored.append(F.struct(F.lit(i).alias("candidate"), vector_to_array(column)[1].alias("probability")))
        (out.select(key, F.col(fold_col).cast("int").alias("fold"), F.col("label").cast("int").alias("y"), F.inline(F.array(*scored)))
         .write.parquet(f"{root}/fit={number}"))

    plan = fit_plan(name, settings) if side is None else [({}, [(i, None) for i in range(len(settings))])]
    jobs = [(f, p) for p in plan for f in range(folds)]
    _parallel(job, list(enumerate(jobs)), parallelism)
    held = spark.read.parquet(root).drop("fit")
    by = {}
    for r in roc_auc(held, ["candidate", "fold"]).collect():  # one row a candidate and fold
        if r["roc_auc"] is not None:
            by.setdefault(r["candidate"], []).append(r["roc_auc"])
    scores = [sum(by[i]) / len(by[i]) if i in by else 0.0 for i in range(len(settings))]
    return scores, held, {i: m for (i, f), m in (side or {}).items() if f is None}


def tune_model(train: DataFrame, name: str, grid: Mapping | None = None, fold_col: str = "fold",
               folds: int = 5, parallelism: int = 4, seed: int = RANDOM_STATE) -> Tuned:
    """M6 grid (or sampled) search with k-fold CV on ROC-AUC, refit on all.

    ``train`` is assembled (``features``, ``label``, optionally ``fold``).
    An empty grid means a plain fit with score 0.0."""
    est = estimator(name, seed)
    if not grid:
        return Tuned(name, est.fit(train), 0.0, {})
    if fold_col not in train.columns:  # written, as a draw would differ from job to job
        train = materialize(train.withColumn(fold_col, F.floor(F.rand(seed) * folds).cast("int")), "folds")
    # every fold fit and the refit iterate over it; fits that go together keep their own matrices
    together = name == "logistic_regression" and train.count() >= TOGETHER_ROWS
    with nullcontext() if together else cached(train):
        n = train.count()
        few = train.coalesce(max(1, -(-n // ROWS_PER_TASK)))
        combos = grid_combinations(grid, seed=seed, settings=lambda c: spark_params(name, c, n))
        settings = [spark_params(name, c, n) for c in combos]
        scores, held, whole = cross_validate(few, name, settings, fold_col, folds, parallelism, seed, together)
        best = max(range(len(scores)), key=lambda i: scores[i])
        fitted = whole.get(best) or est.copy({est.getParam(k): v for k, v in settings[best].items()}).fit(few)
    return Tuned(name, fitted, float(scores[best]), combos[best], settings[best],
                 held.where(F.col("candidate") == best).select("sample_id", "fold", "y", "probability"))


def predict_long(model, data: DataFrame, name: str, type_: str = "individual",
                 id_col: str = "sample_id") -> DataFrame:
    """C1/M7 P(class 1) and class in the long shape."""
    p = model.transform(data)
    return p.select(F.col(id_col).alias("sample_id"), F.lit(name).alias("model"), F.lit(type_).alias("type"),
                    F.col("label").cast("int").alias("y"),
                    vector_to_array("probability")[1].alias("probability"),
                    F.col("prediction").cast("int").alias("prediction"))


def _parallel(fn, items, workers: int):
    """Run independent Spark fits concurrently (jobs from several driver
    threads share the executors, like ``CrossValidator(parallelism)``)."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, workers)) as ex:
        return list(ex.map(fn, items))


def train_all(train: DataFrame, test: DataFrame, names: Sequence[str] = MODEL_NAMES,
              grids: Mapping | None = None, parallelism: int = 4) -> tuple[dict, DataFrame]:
    """M7 tune every model and predict the validation part; returns
    ({name: Tuned}, long predictions).  Models are tuned concurrently."""
    grids = grids if grids is not None else SEARCH_GRIDS
    with cached(train):  # once for all models: none may release it while others fit
        done = _parallel(lambda n: tune_model(train, n, grids.get(n), parallelism=2), list(names), parallelism)
    tuned, preds = {}, None
    for n, t in zip(names, done):
        tuned[n] = t
        p = predict_long(t.model, test, n)
        preds = p if preds is None else preds.unionByName(p)
    return tuned, preds


def feature_importance(spark, tuned: Tuned, features: Sequence[str]) -> DataFrame:
    """M8 trees: importances; logistic regression: |coefficient|; other: empty."""
    m = tuned.model
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray()
    elif hasattr(m, "coefficients"):
        vals = [abs(v) for v in m.coefficients.toArray()]
    else:
        vals = []
    rows = [(tuned.name, f, float(vals[i])) for i, f in enumerate(features)] if len(vals) else []
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def model_summary(spark, tuned: Mapping[str, Tuned]) -> DataFrame:
    """M9 (model, cv_score, best_params) by score desc."""
    rows = [(t.name, float(t.cv_score), json.dumps(t.best_params, sort_keys=True, default=str))
            for t in tuned.values()]
    df = spark.createDataFrame(rows, "model string, cv_score double, best_params string")
    return df.orderBy(F.desc("cv_score"), F.asc("model"))


# ---------------------------------------------------------------- N3 / N7


def _wide(preds: DataFrame, names: Sequence[str]) -> DataFrame:
    """(sample_id, y, p_<model>...) from the long table; ``pivot`` with the
    member list given, so no extra job discovers the pivot values."""
    w = preds.groupBy("sample_id", "y").pivot("model", list(names)).agg(F.first("probability"))
    return w.select("sample_id", "y", *[F.col(n).alias(f"p_{n}") for n in names])


def _meta_frame(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    va = VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="features", handleInvalid="keep")
    return va.transform(wide).select("sample_id", "features", F.col("y").cast("double").alias("label"))


def fit_stack(train: DataFrame, tuned: Mapping[str, Tuned], k: int = 5, parallelism: int = 4):
    """N3 the meta-model: members fitted on k-1 folds predict the held-out fold
    (out-of-fold features for every training row), a logistic regression
    learns from them.  The search has kept the winners' held-out
    predictions; only a member that was not searched is fitted again here, by
    the ``fold`` column of ``train``."""
    names = list(tuned)
    jobs = [(f, n) for n in names if tuned[n].held_out is None for f in range(k)]

    def oof_part(job):
        f, n = job
        fitted = tuned[n].fresh().fit(train.where(F.col("fold") != f))
        return predict_long(fitted, train.where(F.col("fold") == f), n)

    parts = [tuned[n].held_out.select("sample_id", F.lit(n).alias("model"), "y", "probability")
             for n in names if tuned[n].held_out is not None]
    parts += [p.select("sample_id", "model", "y", "probability") for p in _parallel(oof_part, jobs, parallelism)]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return LogisticRegression(maxIter=100).fit(_meta_frame(_wide(oof, names), names))


def stack(train: DataFrame, test: DataFrame, tuned: Mapping[str, Tuned], name: str = "stacking",
          k: int = 5, parallelism: int = 4, meta=None) -> DataFrame:
    """N3 stacking: the meta-model (``fit_stack``) reads the predictions of the
    members fitted on all training rows."""
    names = list(tuned)
    meta = meta if meta is not None else fit_stack(train, tuned, k, parallelism)
    test_preds = None
    for n in names:
        p = predict_long(tuned[n].model, test, n)
        test_preds = p if test_preds is None else test_preds.unionByName(p)
    out = meta.transform(_meta_frame(_wide(test_preds, names), names))
    return out.select("sample_id", F.lit(name).alias("model"), F.lit("ensemble").alias("type"),
                      F.col("label").cast("int").alias("y"),
                      vector_to_array("probability")[1].alias("probability"),
                      F.col("prediction").cast("int").alias("prediction"))


def blend(train_preds: DataFrame, val_preds: DataFrame, name: str = "blending") -> DataFrame:
    """N7 logistic regression on the members' training predictions, applied
    to their validation predictions."""
    names = sorted(r[0] for r in train_preds.select("model").distinct().collect())
    meta = LogisticRegression(maxIter=100).fit(_meta_frame(_wide(train_preds, names), names))
    out = meta.transform(_meta_frame(_wide(val_preds, names), names))
    return out.select("sample_id", F.lit(name).alias("model"), F.lit("ensemble").alias("type"),
                      F.col("label").cast("int").alias("y"),
                      vector_to_array("probability")[1].alias("probability"),
                      F.col("prediction").cast("int").alias("prediction"))
