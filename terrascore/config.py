"""Column presets and thresholds.

Operators never hard-wire column names; they take them as arguments.
``Preset`` maps the canonical (geology) names used by the feature
formulas to the columns of a concrete table.  ``GEOLOGY`` is the identity
mapping for attribute tables with the original names; ``TESTDATA`` maps
the same formulas onto the ``samples`` view so they can be checked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results)
# ---------------------------------------------------------------------------
RANDOM_STATE = 42
TEST_SIZE = 0.2
CV_FOLDS = 5
CORRELATION_THRESHOLD = 0.95
VARIANCE_THRESHOLD = 0.01
MIN_VOTES = 3

TARGET_COLUMN = "likely"
EXCLUDE_COLUMNS = ["geometry", "xcoord", "ycoord"]

GEOLOGICAL_FEATURES = {
    "geochemistry": ["SiO2_%", "Al2O3_%", "Fe2O3_%", "TiO2_%", "CaO_%", "MgO_%",
                     "MnO_%", "Na2O_%", "K2O_%", "P2O5_%", "LOI_%"],
    "trace_elements": ["Ba_ppm", "Ga_ppm", "Sc_ppm", "V_ppm", "Th_ppm", "Pb_ppm",
                       "Ni_ppm", "Co_ppm", "Rb_ppm", "Sr_ppm", "Y_ppm", "Zr_ppm",
                       "Nb_ppm", "Cr_ppm", "Cu_ppm", "Zn_ppm", "Au_ppb"],
    "rare_earth": ["La_ppm", "Ce_ppm", "Pr_ppm", "Nd_ppm", "Sm_ppm", "Eu_ppm",
                   "Tb_ppm", "Gd_ppm", "Dy_ppm", "Ho_ppm", "Er_ppm", "Tm_ppm",
                   "Yb_ppm", "Lu_ppm"],
    "geophysical": ["gravity_ng", "mag_tail_t", "mag_depth", "spec_doser",
                    "spec_Kperc", "spec_Uppm", "spec_Thppm"],
    "structural": ["fault_dist", "lineament"],
}

LITHOLOGY_GOLD_COUNTS = {
    "META-BASALT": 16,
    "ARGILLITE": 15,
    "PILLOWED METABASALT": 9,
    "PINK GRANITE": 3,
    "BANDED IRON FORMATION": 2,
    "QUARTZ VEIN/REEF": 1,
    "GREY HORNBLENDE BIOTITE GNEISS": 1,
    "CHLORITE SERICITE SCHIST": 1,
    "CARBONACEOUS PHYLLITE": 1,
    "CONGLOMERATE": 1,
    "GREY GRANITE": 1,
}
UNKNOWN_CATEGORY_COUNT = 0.5

PATHFINDER_ELEMENTS = ["Au_ppb", "As_ppm", "Sb_ppm", "Bi_ppm", "Cu_ppm", "Pb_ppm", "Zn_ppm"]
ANOMALY_PROBS = [0.75, 0.90, 0.95]
LREE = ["La_ppm", "Ce_ppm", "Pr_ppm", "Nd_ppm", "Sm_ppm"]
HREE = ["Gd_ppm", "Dy_ppm", "Ho_ppm", "Er_ppm", "Tm_ppm", "Yb_ppm", "Lu_ppm"]

# Distance bands: right-closed (lo, hi]; a distance of exactly 0 gets no band.
DISTANCE_BAND_EDGES = [0.0, 500.0, 1000.0, 2000.0, 3000.0, float("inf")]
DISTANCE_BAND_LABELS = ["very_close", "close", "moderate", "far", "very_far"]

# Scoring
SCORING_MAX_DISTANCE = 2300.0
RESCALE_LO, RESCALE_HI = 0.70, 0.95
SCORE_CLASS_THRESHOLD = 0.7
# Priority bands: right-closed (lo, hi]
PRIORITY_BAND_EDGES = [0.0, 0.3, 0.5, 0.7, 0.9, 1.0]
PRIORITY_BAND_LABELS = ["Very Low", "Low", "Moderate", "High", "Very High"]
SURFACE_LEVELS = [0.3, 0.5, 0.7, 0.9]

# Model search grids (reference values)
HYPERPARAMETERS = {
    "random_forest": {
        "n_estimators": [50, 100, 150],
        "max_depth": [3, 5, 7, None],
        "min_samples_split": [5, 10, 15],
        "min_samples_leaf": [3, 5, 7],
        "max_features": ["sqrt", "log2"],
    },
    "xgboost": {
        "n_estimators": [50, 100, 150],
        "max_depth": [2, 3, 4],
        "learning_rate": [0.01, 0.05, 0.1],
        "subsample": [0.6, 0.7, 0.8],
        "colsample_bytree": [0.6, 0.7, 0.8],
        "reg_alpha": [0, 0.1, 1],
        "reg_lambda": [1, 2, 5],
    },
    "logistic_regression": {
        "C": [0.001, 0.01, 0.1, 1, 10],
        "penalty": ["l2"],
        "solver": ["liblinear", "lbfgs"],
        "max_iter": [1000],
    },
}
# Grids searched for extra trees and gradient boosting
EXTRA_TREES_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [10, 20, None],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
}
GRADIENT_BOOSTING_GRID = {
    "n_estimators": [100, 200],
    "learning_rate": [0.01, 0.1, 0.3],
    "max_depth": [3, 5, 7],
    "subsample": [0.7, 0.8, 0.9],
}
MAX_GRID_COMBINATIONS = 50
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Preset:
    """Canonical-name -> table-column mapping plus key/target roles."""

    columns: dict = field(default_factory=dict)
    id_col: str = "sample_id"
    target: str = TARGET_COLUMN
    exclude: tuple = tuple(EXCLUDE_COLUMNS)
    category: str = "lithology"
    distance: str = "fault_dist"
    group_col: str = "lineament"
    x: str = "xcoord"
    y: str = "ycoord"

    def has(self, *names: str) -> bool:
        return all(n in self.columns for n in names)

    def c(self, name: str) -> str:
        return self.columns[name]

    def available(self, columns) -> "Preset":
        """Drop canonical names whose column is not in ``columns``."""
        cols = set(columns)
        return Preset({k: v for k, v in self.columns.items() if v in cols}, self.id_col,
                      self.target, self.exclude, self.category, self.distance,
                      self.group_col, self.x, self.y)


_ALL_CANONICAL = sorted({c for cols in GEOLOGICAL_FEATURES.values() for c in cols}
                        | {"As_ppm", "Sb_ppm", "Bi_ppm"})
GEOLOGY = Preset({c: c for c in _ALL_CANONICAL})

# Test mapping onto the samples view: exercises the formulas only.
TESTDATA = Preset({
    "MgO_%": "q1", "SiO2_%": "q2", "CaO_%": "q3", "K2O_%": "q4", "Na2O_%": "q5",
    "Fe2O3_%": "q3", "Al2O3_%": "q2",
    "Au_ppb": "q1", "As_ppm": "q2", "Sb_ppm": "q3", "Bi_ppm": "q4", "Cu_ppm": "q5",
    "Pb_ppm": "q4", "Zn_ppm": "q2",
    "La_ppm": "q1", "Ce_ppm": "q2", "Pr_ppm": "q3", "Nd_ppm": "q4", "Sm_ppm": "q5",
    "Eu_ppm": "q1", "Gd_ppm": "q3", "Dy_ppm": "q4", "Ho_ppm": "q5", "Er_ppm": "q1",
    "Tm_ppm": "q2", "Yb_ppm": "q3", "Lu_ppm": "q4",
    "mag_tail_t": "q3", "mag_depth": "q5",
    "fault_dist": "fault_dist", "lineament": "lineament",
})
