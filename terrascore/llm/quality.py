"""Quality grades by ordinal cumulative-link regression on hashed text.

The model is P(grade > j) = logistic(w . x - t_j): one weight vector for all
grades and a threshold for each step, in order.  The likelihood of a document
of grade k is the difference of neighbouring links, P(grade > k - 1) - P(grade > k);
thresholds are the first and positive steps from each to the next, so they can't cross.  L-BFGS finds
weights and thresholds together.  Spark hashes the texts and scores them; the
fit reads the hashed vectors of at most ``FIT_DOCS`` rated documents, drawn by
a hash of doc_id.

Ratings.  ``labels`` holds two marks; the grade is 0 for low quality, 1 for
good but toxic and 2 for good text.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import SparkContext
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.llm.shared import documents, fold
from terrascore.session import materialize

FIT_DOCS = 8000
BUCKETS = 1 << 15
TOKEN = r"\p{L}+|[^\p{L}\s]+"
GRADES = 3
#: weight of the squared weights beside the mean of the log likelihood
RIDGE = 1e-6
ROUNDS = 150


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, F.lit(0)).when(toxic == 1, F.lit(1)).when(quality == 1, F.lit(2))


def hashed(docs: DataFrame) -> DataFrame:
    """text -> + ``x``: unit vector of its words and marks, hashed."""
    cut = RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=TOKEN, gaps=False, toLowercase=False)
    count = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=BUCKETS)
    unit = Normalizer(inputCol="_tf", outputCol="x")
    out = unit.transform(count.transform(cut.transform(docs.withColumn("_text", F.coalesce("text", F.lit(""))))))
    return out.drop("_text", "_tokens", "_tf")


def _link(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def thresholds_of(steps: np.ndarray) -> np.ndarray:
    """First threshold and log steps -> thresholds, ascending."""
    return np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))


def loss(params: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, grades: int,
         ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood and its gradient.  ``params``: log steps of
    the thresholds, then the weights; the vectors come as (row, column, value)."""
    k, n = grades - 1, len(grade)
    w, t = params[k:], thresholds_of(params[:k])
    s = np.bincount(rows, values * w[cols], n)
    ends = np.concatenate([[-np.inf], t, [np.inf]])
    hi, lo = _link(ends[grade + 1] - s), _link(ends[grade] - s)
    chance = np.maximum(hi - lo, 1e-300)
    slope_hi, slope_lo = hi * (1 - hi), lo * (1 - lo)
    by_score = (slope_hi - slope_lo) / chance / n
    by_end = np.bincount(grade + 1, -slope_hi / chance / n, k + 2) + np.bincount(grade, slope_lo / chance / n, k + 2)
    # a step moves its threshold and all above
    by_step = np.cumsum(by_end[1:-1][::-1])[::-1]
    by_step[1:] *= np.exp(params[1:k])
    return (float(-np.log(chance).mean() + ridge / 2 * w @ w),
            np.concatenate([by_step, np.bincount(cols, values * by_score[rows], len(w)) + ridge * w]))


def minimise(f, x: np.ndarray, rounds: int = ROUNDS, memory: int = 8, tol: float = 1e-6) -> np.ndarray:
    """L-BFGS with step halving."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(grad).max() < tol:
            break
        d, kept = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d -= a * y
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(grad)))
        for (s, y), a in zip(past, reversed(kept)):
            d += (a - (y @ d) / (s @ y)) * s
        step, slope = 1.0, grad @ d
        while True:
            new = x - step * d
            value_new, grad_new = f(new)
            if value_new <= value - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = new - x, grad_new - grad
        if s @ y > 1e-12:
            past = [*past[-memory + 1:], (s, y)]
        done = value - value_new < 1e-10 * max(1.0, abs(value))
        x, value, grad = new, value_new, grad_new
        if done:
            break
    return x


def fit(docs: DataFrame, rated: DataFrame, fit_docs: int = FIT_DOCS, grades: int = GRADES):
    """Texts and (doc_id, grade) -> (weights, thresholds), or None if fewer
    than two grades occur.  Rows without text count as empty."""
    known = rated.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = known.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(fit_docs)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "quality-sample")
    found = hashed(sample).select("x", "grade").collect()  # hashed vectors of the bounded sample
    grade = np.array([r["grade"] for r in found], dtype=np.int64)
    if len(np.unique(grade)) < 2:
        return None
    rows = np.repeat(np.arange(len(found)), [len(r["x"].indices) for r in found])
    cols = np.concatenate([np.asarray(r["x"].indices) for r in found]).astype(np.int64)
    values = np.concatenate([np.asarray(r["x"].values) for r in found])
    del found
    # thresholds start where the grades' shares put them
    above = np.clip([(grade > j).mean() for j in range(grades - 1)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(grades - 1))
    steps = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    best = minimise(lambda p: loss(p, rows, cols, values, grade, grades), np.concatenate([steps, np.zeros(BUCKETS)]))
    return best[grades - 1:], [float(t) for t in thresholds_of(best[:grades - 1])]


def _scored(x: DataFrame, weights: np.ndarray) -> DataFrame:
    """x -> + ``_m``: the weights' product with each vector, in Spark ML's linear model."""
    ml = SparkContext._active_spark_context._jvm.org.apache.spark.ml
    at = np.flatnonzero(weights)
    vector = ml.linalg.JsonVectorConverter.fromJson(json.dumps(
        {"type": 0, "size": len(weights), "indices": at.tolist(), "values": weights[at].tolist()}))
    model = LogisticRegressionModel(ml.classification.LogisticRegressionModel("quality", vector, 0.0))
    return model.copy({model.featuresCol: "x"}).transform(x).withColumn("_m", vector_to_array(F.col("rawPrediction"))[1])


def rate(docs: DataFrame, fitted, grades: int = GRADES) -> DataFrame:
    """(doc_id, text) -> doc_id, expected (0 to grades - 1), tail
    (P(grade > 0)) and the probabilities ``above_j``, which never rise with j; a
    row for each row.  NULL and empty text has no features: the thresholds
    alone decide.  Without a model everything is 0."""
    named = docs.select("doc_id", "text")
    names = [f"above_{j}" for j in range(grades - 1)]
    if fitted is None:
        return named.select("doc_id", *[F.lit(0.0).alias(c) for c in ["expected", "tail", *names]])
    weights, thresholds = fitted
    x = _scored(hashed(named), weights).select("doc_id", "_m")
    above = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(t) - F.col("_m"))) for t in thresholds]
    total = above[0]
    for a in above[1:]:
        total = total + a
    return x.select("doc_id", total.alias("expected"), above[0].alias("tail"), *[a.alias(c) for a, c in zip(above, names)])


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Grades learned from rows whose crc32(doc_id) mod 4 is not 3; ``chosen``
    where good text is likelier than not."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 4) != 3)
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    out = rate(docs, fit(docs, rated))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 3).alias("held_out"), "expected", "tail",
                      (F.col("tail") >= 0.5).alias("chosen"))
