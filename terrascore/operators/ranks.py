"""H1: distributed running sums and ordinal ranks.

A ``Window.orderBy`` without ``partitionBy`` moves every row into one
task, and ``partitionBy(model)`` moves a whole model's rows into one task.
Instead, at every input size, the rows are shuffled once:

1. range-partition on (group, order) keys and sort inside the ranges; in the
   same stage each row gets what its range alone gives it: its place (a
   number that Spark counts up inside a partition) or the running sums of
   its group (batch by batch with numpy, the last sum carried on).  The rows are written to the
   shared checkpoint folder with the id of their range, as the ranges must
   not change any more,
2. sum the values per (range, group): at most #ranges + #groups rows; a
   window over each group's ranges turns them into what comes before,
3. that small table is joined back; no second exchange of the rows.

A group spread over many ranges (a hot key holding a third of all rows) is
a run of consecutive ranges, so no task holds more than a range of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrascore.session import join_lookup, materialize


def _earlier(sums: DataFrame, values: Sequence[str], gcols: Sequence[str]) -> DataFrame:
    """(_pid, groups, values) -> the values' sums over a group's earlier ranges."""
    before = (Window.partitionBy(*gcols).orderBy("_pid")
              .rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(F.col("_pid").alias("_opid"), *[F.col(g).alias("_o_" + g) for g in gcols],
                       *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias("_off_" + v) for v in values])


def _with_offsets(local: DataFrame, offsets: DataFrame, gcols: Sequence[str]) -> DataFrame:
    on = local["_pid"] == offsets["_opid"]
    for g in gcols:
        on = on & local[g].eqNullSafe(offsets["_o_" + g])
    return join_lookup(local, offsets, on, "inner")


def _key(value) -> str:
    return repr(value + 0.0 if isinstance(value, float) else value)


def _running(ranged: DataFrame, gcols: Sequence[str], vcols: Sequence[str], kinds: dict[str, T.DataType]) -> DataFrame:
    """Running sums inside (range, group) of rows that come sorted."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ranged.columns
    g_at, v_at = [names.index(g) for g in gcols], [names.index(v) for v in vcols]
    whole = [isinstance(kinds[v], T.LongType) for v in vcols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0] * len(vcols)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)  # rows that start a group
            for i in g_at:
                # the codes of equal keys are equal, also those of NULL and NaN, or of both zeros
                keys = batch.column(i)
                keys = pc.add(keys, pa.scalar(0.0, keys.type)) if pa.types.is_floating(keys.type) else keys
                codes = pc.fill_null(keys.dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            key = tuple(_key(batch.column(i)[0].as_py()) for i in g_at)
            if key != last:
                new[0] = True
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: goes on from the batch before
            sums = []
            for k, i in enumerate(v_at):
                kind = np.int64 if whole[k] else np.float64
                v = pc.fill_null(batch.column(i), 0).to_numpy(zero_copy_only=False).astype(kind)
                total = np.cumsum(v)
                at = np.where(start >= 0, total[start] - v[start], 0) if whole[k] else None
                if whole[k]:
                    out = total - at + np.where(start < 0, kind(carried[k]), 0)
                else:  # sums of doubles start afresh in each group, so that none loses places to its neighbour's
                    out, edges = np.empty(n), [0, *[e for e in np.flatnonzero(new) if e], n]
                    for a, b in zip(edges, edges[1:]):
                        out[a:b] = np.cumsum(v[a:b]) + (0.0 if new[a] else carried[k])
                carried[k] = out[-1]
                sums.append(pa.array(out))
            last = tuple(_key(batch.column(i)[n - 1].as_py()) for i in g_at)
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names=[*names, *["_in_" + v for v in vcols]])

    schema = T.StructType([*ranged.schema.fields, *[T.StructField("_in_" + v, kinds[v]) for v in vcols]])
    return ranged.mapInArrow(run, schema)


def prefix_sum(df: DataFrame, order_cols: Sequence[str], value_cols: Sequence[str],
               group_cols: Sequence[str] = (), suffix: str = "_cum",
               num_partitions: int | None = None, native: bool = False) -> DataFrame:
    """Inclusive running sums of ``value_cols`` ordered by ``order_cols`` and
    restarting for every ``group_cols`` key.

    NULL values add nothing, and before any value the sum is 0; NULL is a
    group key like any other.  Rows tied on (group, order) get an arbitrary
    but consistent order; pass a unique tie-breaker in ``order_cols`` when
    row-level values matter.  Output: input columns + ``<v><suffix>`` per
    value column, with the type of SQL's ``sum``.

    ``native`` keeps Python out: the sums inside a range then come from a
    JVM window, at the price of a second exchange.  Values other than whole
    numbers and doubles (decimals) are always summed so."""
    gcols, ocols, vcols = list(group_cols), list(order_cols), list(value_cols)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the types of SQL's sums
    kinds = {v: df.select(F.sum(v).alias(v)).schema[v].dataType for v in vcols}
    ranged = df.repartitionByRange(n, *gcols, *ocols).withColumn("_pid", F.spark_partition_id())
    if native or any(not isinstance(k, (T.LongType, T.DoubleType)) for k in kinds.values()):
        ranged = materialize(ranged, "prefix")
        inside = (Window.partitionBy("_pid", *gcols).orderBy(*ocols)
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        local = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias("_in_" + v) for v in vcols])
        sums = ranged.groupBy("_pid", *gcols).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in vcols])
    else:
        local = materialize(_running(ranged.sortWithinPartitions(*gcols, *ocols), gcols, vcols, kinds), "prefix")
        sums = local.groupBy("_pid", *gcols).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in vcols])
    offsets = materialize(_earlier(sums, vcols, gcols), "prefix-offsets")
    return _with_offsets(local, offsets, gcols).select(
        *df.columns, *[(F.col("_in_" + v) + F.col("_off_" + v)).alias(v + suffix) for v in vcols])


def ordinal_rank(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                 out: str = "rank") -> DataFrame:
    """1-based ``row_number`` over (group, order) without an unbounded
    single-task window, on the JVM alone.

    ``order_cols`` should end with a unique key so the ranking is repeatable.
    """
    gcols, ocols = list(group_cols), list(order_cols)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # inside a sorted range the id counts its rows
    placed = materialize(df.repartitionByRange(n, *gcols, *ocols).sortWithinPartitions(*gcols, *ocols)
                         .withColumn("_id", F.monotonically_increasing_id()), "rank")
    placed = placed.withColumn("_pid", F.shiftrightunsigned("_id", 33)).withColumn("_nth", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    groups = placed.groupBy("_pid", *gcols).agg(F.count(F.lit(1)).alias("_n"), F.min("_nth").alias("_first"))
    earlier = (Window.partitionBy(*gcols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(groups.select(F.col("_pid").alias("_opid"), *[F.col(g).alias("_o_" + g) for g in gcols],
                                        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_off")), "rank-offsets")
    return _with_offsets(placed, offsets, gcols).select(*df.columns, (F.col("_nth") + F.col("_off")).alias(out))
