"""How often the preparation reads its input."""

from pyspark.sql import functions as F

from terrascore.config import TESTDATA
from terrascore.operators import clean as C
from terrascore.plans import training as PL


def _watched(spark, n=60):
    """A samples-like frame, and the number of rows read from it so far."""
    i = F.col("id")
    df = spark.range(n).select(
        i.alias("sample_id"), (i % 7).cast("double").alias("xcoord"), (i % 5).cast("double").alias("ycoord"),
        *[F.when(i % 11 != k, (i * (k + 3)) % 17 + 1.0).alias(f"q{k + 1}") for k in range(5)],
        F.when(i % 13 != 0, i % 4).alias("lineament"), (i * 37 % 3501).cast("double").alias("fault_dist"),
        F.lit("a").alias("lithology"), F.lit("b").alias("formation"), (i % 3 == 0).cast("int").alias("likely"))
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_given_medians_read_the_rows_once(spark):
    df, seen = _watched(spark)
    out, _ = C.clean_data_fit(df, medians={"q1": 5.0, "lineament": 2.0})
    assert out.where("q1 IS NULL OR lineament IS NULL").count() == 0 and out.count() == 60
    assert dict(out.dtypes)["lineament"] == "double" and seen.value == 60


def test_training_reads_the_rows_once(spark):
    df, seen = _watched(spark)
    prep = PL.prepare_training(df, TESTDATA, select=False)
    assert prep.train.count() == 48 and prep.test.count() == 12 and seen.value == 60


def test_ensembles_group_the_predictions_once(spark):
    from terrascore.operators import ensemble as N
    from terrascore.operators import metrics as T

    rows = [(i, m, i % 2, ((i * k) % 100) / 100, int((i * k) % 100 >= 50)) for i in range(40) for m, k in (("a", 7), ("b", 13), ("c", 29)) if (i, m) != (3, "a")]
    rows += [(40, "c", 1, 0.25, 0)]  # no member with a weight
    plain = spark.createDataFrame(rows, "sample_id long, model string, y int, probability double, prediction int")
    seen, weights = spark.sparkContext.accumulator(0), {"a": 3.0, "b": 1.0}

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    out = N.all_ensembles(plain.mapInArrow(run, plain.schema), weights)
    metrics = T.evaluate_models(out).collect()
    assert len(metrics) == 4 and seen.value <= 2 * len(rows)  # the range bounds' sample, and the rows
    want = N.vote_soft(plain).unionByName(N.vote_hard(plain)).unionByName(N.weighted_average(plain, weights)).unionByName(N.rank_average(plain))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == 4 * 41 - 1


def test_fits_pass_over_even_partitions(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    from terrascore.operators import select as L

    cores, fitted = spark.sparkContext.defaultParallelism, []
    for kind in (GBTClassifier, RandomForestClassifier):
        monkeypatch.setattr(kind, "fit", lambda self, data, plain=kind.fit: (fitted.append(data.rdd.getNumPartitions()), plain(self, data))[1])
    i = F.col("id")
    df = spark.range(0, 40 * cores, 1, cores + 1).select((i % 7).cast("double").alias("a"), (i % 5).cast("double").alias("b"), (i % 7 > 3).cast("int").alias("y"))
    few = L.select_rfe(df, ["a", "b"], "y", 1, num_trees=2)
    assert fitted == [cores + 1] and few == ["a"]  # a small table stays as it is
    fitted.clear()
    monkeypatch.setattr(L, "ROWS_PER_TASK", 10)
    assert L.select_rfe(df, ["a", "b"], "y", 1, num_trees=2) == ["a"]
    assert dict(L.tree_importances(df, ["a", "b"], "y", max_iter=2))["a"] > 0.9
    assert fitted == [cores, cores]
    assert sorted(map(tuple, L.balanced(df).collect())) == sorted(map(tuple, df.collect()))
