"""Feature selection.

Statistical selectors are aggregations that return small DataFrames
(one row per feature or feature pair), so the vote is a union-all plus a
``groupBy(feature)`` -- no list ever has to leave Spark:

* L1 population variance > t: one pass, all columns.
* L2 |Pearson r| > t with an earlier column: centred cross-products
  merged on the executors (one p x p matrix reaches the driver).
* L3 binned mutual information: exact decile edges (distributed quantile
  pass), then one pass that counts (feature, bin, label) in Arrow batches
  and adds the counts by ``groupBy`` -- one shuffle of counts for all
  features, output bounded by features x bins x classes.

Model-based selectors (L4-L6) fit Spark ML estimators on an assembled
vector column; only importances / coefficients (one number per feature)
return to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrascore.config import CORRELATION_THRESHOLD, MIN_VOTES, VARIANCE_THRESHOLD
from terrascore.functions import stats
from terrascore.functions.moments import merged, moments
from terrascore.session import materialize

MI_BINS = 10


def _feature_order(spark, cols: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(cols)), "pos int, feature string")


# ---------------------------------------------------------------- L1


def variance_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, variance) population variance, one pass."""
    agg = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in cols])
    return agg.select(F.inline(arr))


def select_variance(df: DataFrame, cols: Sequence[str], threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    """L1 (feature, selected)."""
    v = variance_scores(df, cols)
    return v.select("feature", F.coalesce(F.col("variance") > F.lit(threshold), F.lit(False)).alias("selected"))


# ---------------------------------------------------------------- L2


def correlation_matrix(df: DataFrame, cols: Sequence[str]):
    """Pearson matrix (p x p numpy array) over the complete rows.

    One pass of centred cross-products (``functions.moments``), merged on
    executors.  A column without spread (standard deviation below 1e-12) or
    fewer than two complete rows give NaN."""
    import numpy as np

    cols = list(cols)
    n, _, products = moments(df, cols).get(0, (0, None, None))
    if n < 2:
        return np.full((len(cols), len(cols)), np.nan)
    spread = np.sqrt(np.diag(products) / (n - 1))
    spread = np.where(spread < 1e-12, np.nan, spread)
    r = products / (n - 1) / np.outer(spread, spread)
    return np.where(np.eye(len(cols), dtype=bool), 1.0, r)


def correlation_pairs(df: DataFrame, cols: Sequence[str], matrix=None) -> DataFrame:
    """(feature_a, feature_b, r) for every pair a before b; an undefined r
    (constant column) is NULL.  Built from the p x p matrix (bounded by the
    feature count, not the rows)."""
    import math

    m = matrix if matrix is not None else correlation_matrix(df, cols)
    rows = []
    for j in range(len(cols)):
        for i in range(j):
            r = float(m[i, j])
            rows.append((cols[i], cols[j], None if math.isnan(r) else r))
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def select_correlation(df: DataFrame, cols: Sequence[str], threshold: float = CORRELATION_THRESHOLD,
                       pairs: DataFrame | None = None) -> DataFrame:
    """L2 (feature, selected): drop b if any earlier a (dropped or not) has |r| > t."""
    pairs = pairs if pairs is not None else correlation_pairs(df, cols)
    dropped = (pairs.where(F.abs(F.col("r")) > F.lit(threshold))
                    .select(F.col("feature_b").alias("feature")).distinct()
                    .withColumn("dropped", F.lit(True)))
    allf = _feature_order(df.sparkSession, cols)
    return (allf.join(dropped, "feature", "left")
                .select("feature", F.col("dropped").isNull().alias("selected")))


# ---------------------------------------------------------------- L3


def fit_bin_edges(df: DataFrame, cols: Sequence[str], bins: int = MI_BINS, exact: bool = True) -> dict:
    probs = [i / bins for i in range(1, bins)]
    return stats.quantiles(df, cols, probs, exact=exact)


def bin_counts(df: DataFrame, cols: Sequence[str], label: str, edges: dict) -> DataFrame:
    """(feature, bin, __y, n): rows by bin (the number of edges below the value;
    a missing value is in bin 0) and label."""
    import numpy as np
    import pyarrow as pa

    cols = list(cols)
    cuts = [np.sort(np.array([float(x) for x in edges[c] if x is not None])) for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column(0).dictionary_encode(null_encoding="encode")
            y, m = labels.indices.to_numpy(zero_copy_only=False), len(labels.dictionary)
            found = []
            for i, cut in enumerate(cuts):
                v = batch.column(i + 1)
                at = np.searchsorted(cut, v.to_numpy(zero_copy_only=False), "left")
                if v.null_count:
                    at[v.is_null().to_numpy(zero_copy_only=False)] = 0
                n = np.bincount(at * m + y)
                seen = np.flatnonzero(n)
                found.append((np.full(len(seen), i), seen // m, seen % m, n[seen]))
            k, at, y, n = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), labels.dictionary.take(pa.array(y)), pa.array(n, pa.int64())],
                                             names=["k", "bin", "__y", "n"])

    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("__y", df.schema[label].dataType),
                           T.StructField("n", T.LongType())])
    parts = df.select(F.col(label).alias("__y"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, schema)
    return (parts.groupBy("k", "bin", "__y").agg(F.sum("n").alias("n"))
            .select(F.array(*[F.lit(c) for c in cols])[F.col("k")].alias("feature"), "bin", "__y", "n"))


def mi_scores(df: DataFrame, cols: Sequence[str], label: str, bins: int = MI_BINS,
              edges: dict | None = None) -> DataFrame:
    """L3 (feature, score): mutual information (nats) between the
    decile-binned feature and the label."""
    edges = edges if edges is not None else fit_bin_edges(df, cols, bins)
    # counted once, however often the scores are read
    cnt = materialize(bin_counts(df, cols, label, edges), "bins")
    # the count table has at most features x bins x classes rows
    tot = F.sum("n").over(Window.partitionBy("feature"))
    px = F.sum("n").over(Window.partitionBy("feature", "bin"))
    py = F.sum("n").over(Window.partitionBy("feature", "__y"))
    t = cnt.select("feature", "n", tot.alias("n_all"), px.alias("nx"), py.alias("ny"))
    term = ((F.col("n") / F.col("n_all"))
            * F.log((F.col("n") * F.col("n_all")) / (F.col("nx") * F.col("ny"))))
    # rounded to 12 decimals so equal scores stay equal whatever the
    # summation order (ranks break ties by name)
    return t.groupBy("feature").agg(F.round(F.sum(term), 12).alias("score"))


def ranked(scores: DataFrame, score: str = "score") -> DataFrame:
    """Rank by score then name; ``scores`` has one row per feature."""
    w = Window.orderBy(F.desc(score), F.asc("feature"))
    return scores.withColumn("rank", F.row_number().over(w))


def top_k(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    return ranked(scores, score).where(F.col("rank") <= k)


def select_univariate(df: DataFrame, cols: Sequence[str], label: str, k: int = 30,
                      scores: DataFrame | None = None) -> DataFrame:
    scores = scores if scores is not None else mi_scores(df, cols, label)
    top = top_k(scores, min(k, len(cols))).select("feature", F.lit(True).alias("sel"))
    return (_feature_order(df.sparkSession, cols).join(top, "feature", "left")
            .select("feature", F.coalesce("sel", F.lit(False)).alias("selected")))


# ---------------------------------------------------------------- L4-L6 (model based)


def assemble(df: DataFrame, cols: Sequence[str], label: str, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")
    return va.transform(df).select(out, F.col(label).cast("double").alias("label"))


#: rows that make a table worth dealing out anew before a fit, a task
ROWS_PER_TASK = 20_000


def balanced(df: DataFrame) -> DataFrame:
    """``df`` in a partition a core, all of one size, written once.

    A fit makes dozens of passes, each as long as its busiest core: with a
    partition more than there are cores a pass takes twice as long.  Small
    tables, and those in a multiple of the cores, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() % cores == 0 or df.count() < cores * ROWS_PER_TASK:
        return df
    return materialize(df.repartition(cores), "balanced")


def _importances(model, cols) -> list[tuple[str, float]]:
    imp = model.featureImportances.toArray()
    return [(c, float(imp[i])) for i, c in enumerate(cols)]


def select_rfe(df: DataFrame, cols: Sequence[str], label: str, n_features: int = 30,
               step: int | float = 1, num_trees: int = 100, max_depth: int = 5,
               seed: int = 42) -> list[str]:
    """L4 recursive elimination by random-forest importance: drop the
    weakest ``step`` features (a fraction means that share of the current
    set) until ``n_features`` remain.  The assembled table is cached once;
    each round slices the vector instead of re-reading the data."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorSlicer

    cur = list(cols)
    if len(cur) <= n_features:
        return cur
    data = assemble(balanced(df.select(*cur, label)), cur, label, "all").cache()
    idx = {c: i for i, c in enumerate(cols)}
    try:
        while len(cur) > n_features:
            sl = VectorSlicer(inputCol="all", outputCol="features", indices=[idx[c] for c in cur])
            rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed)
            m = rf.fit(sl.transform(data))
            ranked = sorted(_importances(m, cur), key=lambda t: (t[1], t[0]))
            k = max(1, int(step * len(cur))) if isinstance(step, float) else int(step)
            k = min(k, len(cur) - n_features)
            drop = {c for c, _ in ranked[:k]}
            cur = [c for c in cur if c not in drop]
    finally:
        data.unpersist()
    return cur


def tree_importances(df: DataFrame, cols: Sequence[str], label: str, max_iter: int = 50,
                     max_depth: int = 3, seed: int = 42) -> list[tuple[str, float]]:
    from pyspark.ml.classification import GBTClassifier

    m = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=seed).fit(assemble(balanced(df.select(*cols, label)), cols, label))
    return _importances(m, cols)


def select_tree(df: DataFrame, cols: Sequence[str], label: str, threshold="median",
                importances: list | None = None, **kw) -> list[str]:
    """L5 keep importance >= threshold ('median', 'mean' or a number)."""
    import statistics

    imp = importances if importances is not None else tree_importances(df, cols, label, **kw)
    vals = [v for _, v in imp]
    t = (statistics.median(vals) if threshold == "median" else
         statistics.fmean(vals) if threshold == "mean" else float(threshold))
    return [c for c, v in imp if v >= t]


def lasso_path(products, cross, penalties, tol: float = 1e-10, max_rounds: int = 5000):
    """Coefficients for each penalty in descending order, by coordinate descent
    on the centred products per row (X'X / n, X'y / n), each starting from the last.

    Minimises 1/2 w'(X'X/n)w - w'(X'y/n) + penalty * |w|_1.  Columns without
    spread stay 0."""
    import numpy as np

    own = np.diag(products)
    used = np.flatnonzero(own > 1e-12 * max(own.max(initial=0), 1e-300))
    w, out = np.zeros(len(own)), []
    fit = products @ w  # X'Xw / n
    for penalty in penalties:
        active = used
        for rounds in range(max_rounds):
            largest = 0.0
            for j in active:
                old = w[j]
                rho = cross[j] - fit[j] + own[j] * old
                w[j] = np.sign(rho) * max(abs(rho) - penalty, 0.0) / own[j]
                if w[j] != old:
                    fit += products[:, j] * (w[j] - old)
                    largest = max(largest, abs(w[j] - old) * np.sqrt(own[j]))
            if largest <= tol:
                if len(active) == len(used):
                    break
                active = used  # all columns once more, as one may have become useful
            else:
                active = used[w[used] != 0] if rounds % 10 else used
        out.append(w.copy())
    return out


def lasso_coefficients(df: DataFrame, cols: Sequence[str], label: str, reg_params=None, n_penalties: int = 100,
                       eps: float = 1e-3, folds: int = 5, seed: int = 42) -> tuple[list[tuple[str, float]], float]:
    """L1-penalised linear regression on the 0/1 label, no standardisation,
    the penalty chosen by k-fold CV over a path of ``n_penalties`` values from
    the smallest that leaves no column down to ``eps`` times it (or over
    ``reg_params``).  Returns (coefs, best).

    One pass over the table: the centred products of each fold (dealt by a
    hash of the row) give its complement's by subtraction, the path on them,
    and the held-out error, all on p x p matrices."""
    import numpy as np

    cols = list(cols)
    y = "__label"
    x = df.withColumn(y, F.col(label).cast("double"))
    fold = F.pmod(F.xxhash64(F.lit(seed), *cols, y), F.lit(folds))
    parts = moments(x, [*cols, y], fold)
    whole = None
    for part in parts.values():
        whole = part if whole is None else merged(whole, part)
    if whole is None:
        return [(c, 0.0) for c in cols], 0.0
    p = len(cols)

    def scaled(m):
        return m[2][:p, :p] / m[0], m[2][:p, p] / m[0]

    gram, cross = scaled(whole)
    top = float(np.abs(cross).max(initial=0.0))
    path = sorted(reg_params, reverse=True) if reg_params else list(top * np.logspace(0, np.log10(eps), n_penalties)) if top > 0 else [0.0]
    error, tried = np.zeros(len(path)), 0
    for f, (n, mean, products) in parts.items():
        rest = None
        for other, part in parts.items():
            if other != f:
                rest = part if rest is None else merged(rest, part)
        if rest is None:
            continue
        tried += 1
        gap = mean - rest[1]  # held-out rows about the training means
        seen = products + n * np.outer(gap, gap)
        for i, w in enumerate(lasso_path(*scaled(rest), path)):
            error[i] += (seen[p, p] - 2 * w @ seen[:p, p] + w @ seen[:p, :p] @ w) / n
    best = int(np.argmin(error)) if tried else len(path) - 1
    w = lasso_path(gram, cross, path[:best + 1])[-1]
    return [(c, float(v)) for c, v in zip(cols, w)], float(path[best])


def select_lasso(df: DataFrame, cols: Sequence[str], label: str, **kw) -> list[str]:
    """L6 keep non-zero coefficients."""
    coefs, _ = lasso_coefficients(df, cols, label, **kw)
    return [c for c, v in coefs if v != 0.0]


# ---------------------------------------------------------------- L7-L10


def method_table(spark, method: str, selected: Sequence[str] | DataFrame) -> DataFrame:
    """(method, feature) rows of one selector's choice."""
    if isinstance(selected, DataFrame):
        return selected.where(F.col("selected")).select(F.lit(method).alias("method"), "feature")
    return spark.createDataFrame([(method, f) for f in selected],
                                 T.StructType([T.StructField("method", T.StringType()),
                                               T.StructField("feature", T.StringType())]))


def ensemble_choices(x: DataFrame, cols: Sequence[str], label: str, k: int = 30) -> DataFrame:
    """(method, feature) choices of all six selectors at their defaults."""
    spark = x.sparkSession
    x = balanced(x.select(*cols, label))  # once for both fits
    parts = {"variance": select_variance(x, cols), "correlation": select_correlation(x, cols),
             "univariate": select_univariate(x, cols, label, k), "rfe": select_rfe(x, cols, label, k),
             "tree_based": select_tree(x, cols, label), "lasso": select_lasso(x, cols, label)}
    out = None
    for method, chosen in parts.items():
        t = method_table(spark, method, chosen)
        out = t if out is None else out.unionByName(t)
    return out


def selection_votes(choices: DataFrame, cols: Sequence[str], min_votes: int = MIN_VOTES) -> DataFrame:
    """L7 (pos, feature, votes, selected): votes = number of methods choosing
    the feature, kept at >= min_votes; ``pos`` keeps the input order."""
    v = choices.groupBy("feature").agg(F.count_distinct("method").alias("votes"))
    allf = _feature_order(choices.sparkSession, cols)
    return (allf.join(v, "feature", "left")
                .select("pos", "feature", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"))
                .withColumn("selected", F.col("votes") >= F.lit(min_votes)))


def feature_scores(scores: DataFrame, method: str) -> DataFrame:
    """L8 (method, feature, score, rank) ranked by score desc then name."""
    return ranked(scores).select(F.lit(method).alias("method"), "feature", "score", "rank")


def selection_report(choices: DataFrame, top: int = 10) -> DataFrame:
    """L9 per method: number of features and the first ``top`` names
    (in feature order, ``choices`` needs ``pos``)."""
    w = Window.partitionBy("method").orderBy("pos")
    r = choices.withColumn("rn", F.row_number().over(w))
    return r.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.array_sort(F.collect_list(F.when(F.col("rn") <= top, F.struct("pos", "feature")))).alias("_f")
    ).select("method", "n_features", F.transform("_f", lambda s: s["feature"]).alias("first_features"))


def selection_summary(choices: DataFrame) -> DataFrame:
    """L10 features per method."""
    return choices.groupBy("method").agg(F.count(F.lit(1)).alias("n_features"))


def score_tops(tables: dict[str, DataFrame], top: int = 10) -> DataFrame:
    """L9/L10 (method, rank, feature, score): the first ``top`` rows of each
    score table (feature, score), by score then name."""
    out = None
    for method, t in tables.items():
        rows = top_k(t.select("feature", F.col("score").cast("double").alias("score")), top).select(
            F.lit(method).alias("method"), "rank", "feature", "score")
        out = rows if out is None else out.unionByName(rows)
    return out
