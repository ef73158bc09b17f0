"""Domain features.

Scalar features are expressions; fitted ones (mean normalisation,
quantile tiers) take statistics from ``fit_feature_stats`` -- gathered in
one mean pass and one distributed quantile pass for all columns -- and
the group density is a ``groupBy.count`` joined back on the key (map-side
combine, skew-safe; no window over the key).  ``engineer_features``
applies everything in one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.config import (ANOMALY_PROBS, DISTANCE_BAND_EDGES, DISTANCE_BAND_LABELS,
                               GEOLOGICAL_FEATURES, HREE, LREE, PATHFINDER_ELEMENTS, Preset)
from terrascore.functions import stats
from terrascore.functions.expr import (add_all, finite_or_zero, ratio, row_sum, safe_div,
                                       share_index)

# ----------------------------------------------------------------- scalars


def alteration_index(p: Preset) -> Column:
    """F1 (K2O+MgO)/(K2O+MgO+Na2O+CaO)*100."""
    return share_index([p.c("K2O_%"), p.c("MgO_%")], [p.c("Na2O_%"), p.c("CaO_%")])


def ccpi_index(p: Preset) -> Column:
    """F2 (MgO+Fe2O3)/(MgO+Fe2O3+Na2O+K2O)*100."""
    return share_index([p.c("MgO_%"), p.c("Fe2O3_%")], [p.c("Na2O_%"), p.c("K2O_%")])


def sericite_index(p: Preset) -> Column:
    """F3 K2O/(K2O+Na2O+0.001)*100."""
    return share_index([p.c("K2O_%")], [p.c("Na2O_%")], eps=0.001)


def mean_normalize(column: str, mean: float | None) -> Column:
    """F4 x / mean(x) of the fitted frame."""
    return safe_div(column, F.lit(mean).cast("double"))


ELEMENT_RATIOS = [("Au_As_ratio", "Au_ppb", "As_ppm"), ("Au_Sb_ratio", "Au_ppb", "Sb_ppm"),
                  ("Cu_Pb_ratio", "Cu_ppm", "Pb_ppm"), ("Zn_Pb_ratio", "Zn_ppm", "Pb_ppm")]


def element_ratio(num: str, den: str) -> Column:
    """F5-F8 num/(den+0.001)."""
    return ratio(num, den, eps=0.001)


def mafic_index(p: Preset) -> Column:
    """F9 (MgO+Fe2O3)/SiO2."""
    return safe_div(add_all([p.c("MgO_%"), p.c("Fe2O3_%")]), p.c("SiO2_%"))


def alkalinity_ratio(p: Preset) -> Column:
    """F10 (Na2O+K2O)/Al2O3."""
    return safe_div(add_all([p.c("Na2O_%"), p.c("K2O_%")]), p.c("Al2O3_%"))


def distance_band(column: str, edges=DISTANCE_BAND_EDGES, labels=DISTANCE_BAND_LABELS) -> Column:
    """F11 right-closed bands (lo, hi]; values <= first edge or missing -> NULL."""
    x = F.col(column)
    out = F.lit(None).cast("string")
    for lo, hi, lab in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((x > F.lit(lo)) & (x <= F.lit(hi)), F.lit(lab)).otherwise(out)
    return out


def band_one_hot(column: str, prefix: str = "fault_cat", edges=DISTANCE_BAND_EDGES,
                 labels=DISTANCE_BAND_LABELS) -> list[tuple[str, Column]]:
    """F12 one boolean per band, all always present; missing band -> all false."""
    band = distance_band(column, edges, labels)
    return [(f"{prefix}_{lab}", F.coalesce(band == F.lit(lab), F.lit(False))) for lab in labels]


def mag_gradient(p: Preset) -> Column:
    """F14 mag_tail_t/(mag_depth+1)."""
    return ratio(p.c("mag_tail_t"), p.c("mag_depth"), eps=1.0)


def anomaly_tier(column: str, q75: float | None, q90: float | None, q95: float | None) -> Column:
    """F15 0/1/2/3 for value strictly above P75/P90/P95; missing -> 0."""
    x = F.col(column)

    def gt(q):
        return F.lit(False) if q is None else F.coalesce(x > F.lit(float(q)), F.lit(False))

    return (F.when(gt(q95), F.lit(3)).when(gt(q90), F.lit(2)).when(gt(q75), F.lit(1))
            .otherwise(F.lit(0))).cast("int")


def lree_sum(p: Preset) -> Column:
    return row_sum([p.c(c) for c in LREE])


def hree_sum(p: Preset) -> Column:
    return row_sum([p.c(c) for c in HREE])


def eu_anomaly(p: Preset) -> Column:
    """F21 Eu/sqrt(Sm*Gd+0.001); a negative radicand gives NaN -> 0 later."""
    rad = F.col(p.c("Sm_ppm")).cast("double") * F.col(p.c("Gd_ppm")).cast("double") + F.lit(0.001)
    return safe_div(p.c("Eu_ppm"), F.sqrt(rad))


# ----------------------------------------------------------------- density


def group_counts(df: DataFrame, key: str, out: str = "lineament_density") -> DataFrame:
    """Rows per non-missing key (map-side combined)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def group_density(df: DataFrame, key: str, out: str = "lineament_density",
                  counts: DataFrame | None = None) -> DataFrame:
    """F13 size of the row's own group; missing key -> missing.

    ``counts`` may come from another frame (frozen statistics, a written
    table); else they are counted and written here.  They are joined by
    ``join_lookup``, so few groups do not shuffle the whole table."""
    from terrascore.session import join_lookup, materialize

    counts = counts if counts is not None else materialize(group_counts(df, key, out), "group_counts")
    return join_lookup(df, counts, key)


# ----------------------------------------------------------------- fitted stats


def anomaly_elements(p: Preset) -> list[str]:
    return [e for e in PATHFINDER_ELEMENTS if p.has(e)]


def fit_anomaly_stats(df: DataFrame, columns: Sequence[str], exact: bool = True,
                      probs=ANOMALY_PROBS) -> dict[str, list[float | None]]:
    return stats.quantiles(df, sorted(set(columns)), probs, exact=exact)


def anomaly_tiers(df: DataFrame, columns: dict[str, str] | Sequence[str], q=None,
                  exact: bool = True) -> DataFrame:
    """F15 for several columns; ``columns`` maps output name -> input column
    (a list means ``<col>_anomaly``)."""
    if not isinstance(columns, dict):
        columns = {f"{c}_anomaly": c for c in columns}
    q = q if q is not None else fit_anomaly_stats(df, list(columns.values()), exact)
    return df.select("*", *[anomaly_tier(src, *q[src]).alias(name) for name, src in columns.items()])


def anomaly_tier_counts(df: DataFrame, tier_cols: Sequence[str]) -> DataFrame:
    """F16 (feature, tier, n)."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("tier")) for c in tier_cols])
    return (df.select(F.inline(arr)).groupBy("feature", "tier")
              .agg(F.count(F.lit(1)).alias("n")))


def composite_anomaly(tier_cols: Sequence[str]) -> Column:
    """F17 row sum of the tier columns."""
    return add_all([F.col(c) for c in tier_cols]).cast("long")


def fit_feature_stats(df: DataFrame, p: Preset, exact: bool = True) -> dict:
    """All statistics F1-F21 need: one mean pass, one quantile pass and the
    group counts of the density feature (a table with one row per key,
    written to the checkpoint folder so later frames -- a scoring table,
    stream micro-batches -- join the same counts)."""
    from terrascore.session import materialize

    means = stats.means(df, [p.c("SiO2_%")]) if p.has("SiO2_%") else {}
    elems = anomaly_elements(p)
    q = fit_anomaly_stats(df, [p.c(e) for e in elems], exact) if elems else {}
    out = {"means": means, "quantiles": q}
    if p.has("lineament"):
        out["group_counts"] = materialize(group_counts(df, p.c("lineament")), "group_counts")
    return out


# ----------------------------------------------------------------- whole step


def feature_expressions(p: Preset, st: dict | None, density_col: str | None = None,
                        build: bool = True) -> list[tuple[str, Column | None]]:
    """(name, expression) of F1-F21 in the reference order, guarded by
    "all required columns present".  ``build=False`` lists names only."""
    out: list[tuple[str, Column | None]] = []

    def add(name, fn):
        out.append((name, fn() if build else None))

    if p.has("K2O_%", "Na2O_%", "CaO_%", "MgO_%"):
        add("alteration_index", lambda: alteration_index(p))
    if p.has("MgO_%", "Fe2O3_%", "K2O_%", "Na2O_%"):
        add("ccpi_index", lambda: ccpi_index(p))
    if p.has("K2O_%", "Na2O_%"):
        add("sericite_index", lambda: sericite_index(p))
    if p.has("SiO2_%"):
        add("silicification_index", lambda: mean_normalize(p.c("SiO2_%"), st["means"][p.c("SiO2_%")]))
    for name, num, den in ELEMENT_RATIOS:
        if p.has(num, den):
            add(name, lambda num=num, den=den: element_ratio(p.c(num), p.c(den)))
    if p.has("MgO_%", "Fe2O3_%", "SiO2_%"):
        add("mafic_index", lambda: mafic_index(p))
    if p.has("Na2O_%", "K2O_%", "Al2O3_%"):
        add("alkalinity_ratio", lambda: alkalinity_ratio(p))
    if p.has("fault_dist"):
        for i, lab in enumerate(DISTANCE_BAND_LABELS):
            add(f"fault_cat_{lab}", lambda i=i: band_one_hot(p.c("fault_dist"))[i][1])
    if density_col:
        add("lineament_density", lambda: F.col(density_col))
    if p.has("mag_tail_t", "mag_depth"):
        add("mag_gradient", lambda: mag_gradient(p))
    tiers = []
    for e in anomaly_elements(p):
        src = p.c(e)
        add(f"{e}_anomaly", lambda src=src: anomaly_tier(src, *st["quantiles"][src]))
        tiers.append(f"{e}_anomaly")
    if tiers:
        add("composite_anomaly_score", lambda: composite_anomaly(tiers))
    if p.has(*LREE):
        add("LREE_sum", lambda: lree_sum(p))
    if p.has(*HREE):
        add("HREE_sum", lambda: hree_sum(p))
    if p.has(*LREE, *HREE):
        add("LREE_HREE_ratio", lambda: safe_div(lree_sum(p), hree_sum(p) + F.lit(0.001)))
    if p.has("Eu_ppm", "Sm_ppm", "Gd_ppm"):
        add("Eu_anomaly", lambda: eu_anomaly(p))
    return out


def engineer_features(df: DataFrame, p: Preset, st: dict | None = None, exact: bool = True,
                      density_counts: DataFrame | None = None,
                      extra: dict[str, Column] | None = None) -> DataFrame:
    """F1-F21 (+ user ``extra`` expressions), then +-inf/missing -> 0 on
    every numeric column but the key, the target and the excluded ones, which
    are no measurements: a missing coordinate or label stays missing.  Band
    dummies stay boolean."""
    p = p.available(df.columns)
    st = st if st is not None else fit_feature_stats(df, p, exact)
    base = df
    dens = None
    if p.has("lineament"):
        dens = "__density"
        if density_counts is None:
            density_counts = st.get("group_counts")
        base = group_density(df, p.c("lineament"), dens, density_counts)
        if density_counts is not None and dens not in base.columns:
            base = base.withColumnRenamed(density_counts.columns[-1], dens)
    feats = feature_expressions(p, st, dens)
    feats += list((extra or {}).items())
    new_names = [n for n, _ in feats]
    keep = [c for c in df.columns if c not in new_names]
    sel = [F.col(c) for c in keep] + [e.alias(n) for n, e in feats]
    wide = base.select(*sel)
    held = {p.id_col, p.target, *p.exclude}
    return wide.select(*[F.col(c) if c in held else _zero_missing(wide, c) for c in wide.columns])


def _zero_missing(df: DataFrame, c: str) -> Column:
    """The final clean-up: float +-inf/NaN/missing -> 0, integer missing -> 0
    (type kept), other columns unchanged."""
    from pyspark.sql import types as T
    dt = df.schema[c].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return finite_or_zero(c).alias(c)
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.coalesce(F.col(c), F.lit(0).cast(dt)).alias(c)
    return F.col(c)


def created_features(p: Preset) -> list[str]:
    """Names ``engineer_features`` creates for a preset (29 when complete)."""
    return [n for n, _ in feature_expressions(p, None, "x" if p.has("lineament") else None, build=False)]


def feature_categories(features: Sequence[str], groups: dict | None = None) -> list[tuple[str, str]]:
    """F23 name -> configured group, else 'index'/'ratio'/'anomaly' substring ->
    'engineered', else 'other'."""
    groups = groups or GEOLOGICAL_FEATURES
    lookup = {f: g for g, fs in groups.items() for f in fs}
    out = []
    for f in features:
        if f in lookup:
            out.append((f, lookup[f]))
        elif "index" in f or "ratio" in f or "anomaly" in f:
            out.append((f, "engineered"))
        else:
            out.append((f, "other"))
    return out


#: created features by what their names hold
ENGINEERED_GROUPS = {
    "engineered_alteration": ("index", "ratio"),
    "engineered_anomaly": ("anomaly",),
    "engineered_spatial": ("fault", "lineament", "mag"),
    "engineered_ree": ("REE", "Eu_anomaly"),
}


def feature_groups(created: Sequence[str], groups: dict | None = None) -> list[tuple[str, str]]:
    """F23 (group, feature): the configured groups, and four groups of created
    features by what their names hold; a feature may be in several."""
    out = [(g, f) for g, fs in (groups or GEOLOGICAL_FEATURES).items() for f in fs]
    return out + [(g, f) for g, marks in ENGINEERED_GROUPS.items() for f in created if any(m in f for m in marks)]


def log1p(column: str) -> Column:
    """F24."""
    return F.log1p(F.col(column).cast("double"))
