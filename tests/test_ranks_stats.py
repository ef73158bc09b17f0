"""H1 prefix sums and exact quantiles against plain windows / numpy."""

import math
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrascore.functions import stats
from terrascore.operators.ranks import ordinal_rank, prefix_sum


def _rows(n=3000, seed=1):
    rnd = random.Random(seed)
    # one hot group holding ~1/3 of the rows, many ties
    return [(i, rnd.choice(["hot", "hot", "hot", "a", "b", "c", "d", "e", None]),
             rnd.randint(0, 50) / 2.0, rnd.randint(1, 3)) for i in range(n)]


def test_prefix_sum_equals_window(spark):
    df = spark.createDataFrame(_rows(), "id long, g string, v double, w long")
    got = prefix_sum(df, ["v", "id"], ["w"], group_cols=["g"], num_partitions=6)
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("exp", F.sum("w").over(w))
    j = got.join(exp, "id")
    assert j.count() == df.count()
    assert j.where(F.col("w_cum") != F.col("exp")).count() == 0


def test_prefix_sum_nulls_nan_keys_and_large_longs(spark):
    nan = float("nan")
    big = 2 ** 60
    rows = [(1, nan, big + 1, None), (2, None, big + 3, 5), (3, nan, None, 7), (4, None, 2, None), (5, 1.0, 4, 1)]
    df = spark.createDataFrame(rows, "id long, g double, keep long, w long")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = {r["id"]: (r["keep"], r["w_cum"]) for r in
           prefix_sum(df, ["id"], ["w"], group_cols=["g"], num_partitions=3).collect()}
    assert got == {1: (big + 1, 0), 2: (big + 3, 5), 3: (None, 7), 4: (2, 5), 5: (4, 1)}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


def test_prefix_sum_no_groups_and_rank(spark):
    df = spark.createDataFrame([(i, float(i % 17)) for i in range(500)], "id long, v double")
    r = ordinal_rank(df, ["v", "id"], out="rk")
    exp = df.withColumn("e", F.row_number().over(Window.orderBy("v", "id")))
    assert r.join(exp, "id").where(F.col("rk") != F.col("e")).count() == 0


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([None, float(rnd.randint(0, 30))]) for _ in range(997)]
    vals2 = [rnd.gauss(0, 1) for _ in range(997)]
    df = spark.createDataFrame(list(zip(vals, vals2)), "a double, b double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    q = stats.exact_quantiles(df, ["a", "b"], probs)
    for c, xs in (("a", vals), ("b", vals2)):
        arr = np.array([x for x in xs if x is not None])
        for p, got in zip(probs, q[c]):
            assert math.isclose(got, float(np.quantile(arr, p)), rel_tol=1e-12, abs_tol=1e-12)


def test_quantile_ties_and_all_null(spark):
    # 20 values with ties exactly at P75/P90/P95
    vals = [1.0] * 10 + [2.0] * 5 + [3.0] * 3 + [4.0, 5.0]
    df = spark.createDataFrame([(v, None) for v in vals], "x double, e double")
    q = stats.exact_quantiles(df, ["x", "e"], [0.75, 0.9, 0.95])
    assert q["x"] == [float(np.quantile(vals, p)) for p in (0.75, 0.9, 0.95)]
    assert q["e"] == [None, None, None]


def test_grouped_quantiles(spark):
    rows = [(g, float(v)) for g in ("x", "y") for v in range(11 if g == "x" else 5)]
    df = spark.createDataFrame(rows, "g string, v double")
    q = stats.grouped_quantiles(df, "g", ["v"], [0.5])
    assert q[("x", "v")] == [5.0] and q[("y", "v")] == [2.0]


def test_quantiles_whose_brackets_miss(spark):
    """A coarse sketch on skewed values with ties: brackets are widened until
    each rank lies in one."""
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "a", "b", None]), rnd.paretovariate(0.3), float(rnd.randint(0, 3)), None if i % 3 else float("nan")) for i in range(2000)]
    rows += [("a", float("inf"), -0.0, None), ("b", float("-inf"), 0.0, 1.0), ("one", 5.0, None, None)]
    df = spark.createDataFrame(rows, "g string, x double, t double, e double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.505, 0.9, 0.999, 1.0]
    for accuracy in (2, 10, 1000):
        got = stats.exact_quantiles(df, ["x", "t", "e"], probs, accuracy)
        by = stats.grouped_quantiles(df, "g", ["x", "t", "e"], probs, accuracy)
        for i, c in enumerate(("x", "t", "e"), 1):
            for g in ("all", "a", "b", None, "one"):
                xs = np.sort([r[i] for r in rows if r[i] is not None and r[i] == r[i] and g in ("all", r[0])])
                found = got[c] if g == "all" else by.get((g, c))
                if not len(xs):
                    assert found in (None, [None] * len(probs))
                    continue
                for p, v in zip(probs, found):
                    at = p * (len(xs) - 1)
                    a, b = xs[math.floor(at)], xs[min(math.floor(at) + 1, len(xs) - 1)]
                    assert v == (a if a == b or at == math.floor(at) else a + (b - a) * (at - math.floor(at)))


def test_ordinal_rank_in_groups_and_one_exchange(spark):
    df = spark.createDataFrame(_rows(), "id long, g string, v double, w long")
    r = ordinal_rank(df, ["v", "id"], ["g"], out="rk")
    exp = df.withColumn("e", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert r.join(exp, "id").where(F.col("rk") == F.col("e")).count() == df.count()
    # what is left of the plan reads the written rows and joins a small table: no exchange of rows
    for made in (r, prefix_sum(df, ["v", "id"], ["w"], ["g"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_running_sums_of_doubles_and_zero_keys(spark):
    rows = [(i, [0.0, -0.0, 1.5, None][i % 4], 0.1 * i, None if i % 5 == 0 else 1.0 / (i + 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g double, v double, w double")
    for native in (False, True):
        got = {r["id"]: r["w_cum"] for r in prefix_sum(df, ["v", "id"], ["w"], ["g"], num_partitions=5, native=native).collect()}
        for g in (0.0, 1.5, None):
            total = 0.0
            for i, k, v, w in sorted((r for r in rows if r[1] == g), key=lambda r: r[2]):
                total += w or 0.0
                assert math.isclose(got[i], total, rel_tol=1e-12)
