"""E10 / E11 and the two entries of the reference's main program.

Training (entry A): de-duplicate -> split -> clean -> features -> vote of
six selectors -> robust scaling (every statistic fitted on the training
part) -> assemble -> tune the
five classifiers -> ensembles -> evaluation.  Scoring (entry B): filter
by known category and distance -> the same cleaning/features -> the
training feature list and scaler -> best model -> rescale, class,
bands.

The fitted state (medians, feature statistics, feature list, scaler,
vocabulary) is a small dict, so a scoring table or a stream is
transformed with the training statistics; ``refit_on_score=True``
recomputes medians/feature statistics on the scoring table instead, as
the reference does.

Assembled training and validation tables are written once to the shared
checkpoint folder: cross-validation reads them many times, and a lost
executor then re-reads files instead of recomputing the feature jobs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.config import MIN_VOTES, TESTDATA, Preset
from terrascore.operators import clean as C
from terrascore.operators import features as FE
from terrascore.operators import models as M
from terrascore.operators import sample as SA
from terrascore.operators import scale as SC
from terrascore.operators import select as L
from terrascore.session import materialize


@dataclass
class PrepState:
    preset: Preset
    medians: dict
    feature_stats: dict
    features: list
    scaler: dict
    extra: dict = field(default_factory=dict)


@dataclass
class Prepared:
    state: PrepState
    train: DataFrame
    test: DataFrame


def engineered(df: DataFrame, preset: Preset = TESTDATA, medians=None, feature_stats=None,
               exact: bool = True):
    """clean_data + engineer_features; returns (frame, medians, feature stats)."""
    p = preset.available(df.columns)
    fitting = medians is None or feature_stats is None
    d, medians = C.clean_data_fit(df, p.exclude, p.target, medians, exact)
    if fitting:  # several statistics passes follow: read the cleaned table once
        d = materialize(d, "clean")
    st = feature_stats if feature_stats is not None else FE.fit_feature_stats(d, p, exact)
    return FE.engineer_features(d, p, st), medians, st


def voted_features(x: DataFrame, cols, label: str, min_votes: int = MIN_VOTES, k: int = 30) -> list[str]:
    """Features that at least ``min_votes`` of the six selectors choose."""
    v = L.selection_votes(L.ensemble_choices(x, cols, label, k), cols, min_votes).where("selected").orderBy("pos")
    return [r["feature"] for r in v.collect()]  # one row per feature


def prepare_training(df: DataFrame, preset: Preset = TESTDATA, select: bool = True,
                     include=(), exclude=(), exact: bool = True, folds: int = 5) -> Prepared:
    """E10 load -> split -> clean -> features -> (selection) -> scale.  The
    split comes first, so no statistic sees the validation part."""
    p = preset
    # written: the class counts, the ranges of the ranking and the ranking read it
    d = materialize(C.cast_target(C.drop_duplicates(df), p.target), "input")
    flagged = materialize(SA.stratified_split(d, p.id_col, p.target), "split")
    train, test = SA.split(flagged)
    eng, medians, st = engineered(train, p, exact=exact)
    cols = candidates = C.feature_columns(eng, p.exclude, p.target, p.id_col)
    x = materialize(C.prepare_features(eng, cols, keep=[p.id_col, p.target]), "features")
    if select:
        cols = C.feature_override(voted_features(x, cols, p.target), include, exclude)
    held, _, _ = engineered(test, p, medians, st, exact)
    train = SA.stratified_folds(x, p.id_col, p.target, k=folds)
    scaler = SC.fit_robust_scaler(x, cols, exact=exact)
    held = C.prepare_features(held, cols, keep=[p.id_col, p.target])
    tr = M.assemble(SC.apply_robust_scaler(train, scaler), cols, p.target, keep=[p.id_col])
    te = M.assemble(SC.apply_robust_scaler(held, scaler), cols, p.target, keep=[p.id_col])
    tr = materialize(tr, "train")
    te = materialize(te, "test")
    return Prepared(PrepState(p, medians, st, cols, scaler, {"candidates": candidates}), tr, te)


def prepare_scoring(df: DataFrame, state: PrepState, refit_on_score: bool = False) -> DataFrame:
    """E11 transform a scoring table with the training state (the
    reference refits cleaning/feature statistics on it: ``refit_on_score``)."""
    p = state.preset
    if refit_on_score:
        eng, _, _ = engineered(df, p)
    else:
        eng, _, _ = engineered(df, p, state.medians, state.feature_stats)
    carry = [c for c in (p.x, p.y, p.distance) if c in eng.columns]
    x = C.prepare_features(eng.select("*", *[F.col(c).alias(f"__keep_{c}") for c in carry]),
                           state.features, keep=[p.id_col] + [f"__keep_{c}" for c in carry])
    scaled = SC.apply_robust_scaler(x, state.scaler)
    out = M.assemble(scaled, state.features, p.target, keep=[p.id_col] + [f"__keep_{c}" for c in carry])
    for c in carry:
        out = out.withColumnRenamed(f"__keep_{c}", c)
    return out


def train_and_evaluate(prep: Prepared, names=M.MODEL_NAMES, grids=None, stacking: bool = True):
    """Entry A after preparation: tune -> predict -> ensembles -> metrics.

    Returns dict with ``tuned``, ``predictions`` (members + ensembles),
    ``metrics``."""
    from terrascore.operators import ensemble as N
    from terrascore.operators import metrics as T

    tuned, preds = M.train_all(prep.train, prep.test, names, grids)
    preds = materialize(preds, "predictions")
    ens = N.all_ensembles(preds)
    if stacking:
        ens = ens.unionByName(M.stack(prep.train, prep.test, tuned))
    allp = preds.unionByName(ens)
    metrics = T.evaluate_models(allp)
    return {"tuned": tuned, "predictions": allp, "metrics": metrics}


def score_table(model, assembled: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """C1/C2 raw P(class 1) keyed by sample id, with coordinates and distance."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(assembled)
    keep = [c for c in assembled.columns if c not in ("features", "label")]
    return out.select(*keep, vector_to_array("probability")[1].alias("raw_score"))
