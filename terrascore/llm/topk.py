"""Exact top-k inner products over an impact-ordered index, score at a time.

A component's impact is floor(256 * x).  The index keeps blocks of vectors;
a block's postings (member, dimension) are stored in descending order of the
impact's size, cut into segments at quantised impacts.  A block of queries takes the
segments in that order: a segment adds each query's products with its
postings at once (a matrix product).  What is still to come of a member is at
most the length of the query times that of the member's postings not yet
taken, which bounds every score from both sides.  The k-th lower bound of a
query is a score that is sure to be reached; when few members can still reach
it, they are scored exactly and the block is done: nothing else can belong to
the answer.  Rows of the query's own id are left out before any bound.

Blocks of vectors and of queries meet by an equi-join on the tiles of a grid,
so neither side is broadcast or gathered, each block is copied about as often
as the root of the number of tiles, and a meeting returns k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascore.session import materialize

SCALE = 256
VECTORS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512
#: ends of the segments, as shares of a block's largest impact
TIERS = (0.5, 0.25, 0.0)
FEW = 0.03


def impacts(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) -> id, impacts (array of longs).  Vectors that are NULL
    or hold a NULL or non-finite component, and rows without id, are left out."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("impacts")))


def _blocks(rows: DataFrame, per_block: int, n: int) -> DataFrame:
    """(id, impacts) -> block, ids, values (row-major longs), width, postings
    and cuts: up to ``per_block`` vectors a row.  Shorter vectors among longer
    ones count as ending in zeros."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, values, part = [], [], 0

        def out():
            m = np.zeros((len(ids), max(map(len, values), default=0)), np.int64)
            for i, v in enumerate(values):
                m[i, :len(v)] = v
            postings, cuts = impact_order(m)
            return pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() + (part << 32)]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                 pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]]), pa.array([postings.tobytes()], pa.binary()),
                 pa.array([cuts], pa.list_(pa.int64()))], names=["block", "ids", "values", "width", "postings", "cuts"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), (x.values.to_numpy(zero_copy_only=False) for x in batch.column(1))):
                if len(ids) == per_block:
                    yield out()
                    ids, values, part = [], [], part + 1
                ids.append(i)
                values.append(v)
        if ids:
            yield out()

    # dealt by all that a row has: one id may hold any share of the rows
    return rows.repartition(n, F.xxhash64("id", "impacts")).mapInArrow(
        pack, "block long, ids binary, values binary, width long, postings binary, cuts array<long>")


def impact_order(values: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Flat places of the postings by descending size of impact, and where
    each segment ends; zero impacts are no postings."""
    size = np.abs(values).ravel()
    order = np.argsort(-size, kind="stable").astype(np.int32)
    ranked = -size[order]
    top = int(size.max(initial=0))
    return order, [int(np.searchsorted(ranked, -max(1, int(top * t)), "right")) for t in TIERS]


def search_block(ids: np.ndarray, values: np.ndarray, postings: np.ndarray, cuts: list[int], query_ids: np.ndarray,
                 queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member id, score) of the k best members for each query, ties to
    the smaller id; members with the query's id are left out."""
    n, m = len(ids), len(query_ids)
    width = max(values.shape[1], queries.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    exact = float(np.abs(values).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1) < 2 ** 53
    kind = np.float64 if exact else np.int64  # whole numbers below 2^53 are exact in doubles
    q, left = queries[:, :values.shape[1]].astype(kind), values.astype(kind)
    order = np.argsort(ids, kind="stable")
    lo, hi = np.searchsorted(ids[order], query_ids, "left"), np.searchsorted(ids[order], query_ids, "right")
    own_q = np.repeat(np.arange(m), hi - lo)
    own_v = order[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])] if len(own_q) else np.zeros(0, np.int64)

    possible = np.ones((m, n), bool)
    if exact and n > 8 * k:
        scores, length, at = np.zeros((m, n)), np.sqrt((q ** 2).sum(axis=1)), 0
        for cut in cuts[:-1]:
            segment = np.zeros(n * values.shape[1])
            taken = postings[at:cut]
            segment[taken] = left.ravel()[taken]
            scores += q @ segment.reshape(n, -1).T
            left.ravel()[taken], at = 0, cut
            # rounding of the lengths is far below a part in 10^9
            slack = length[:, None] * np.sqrt((left ** 2).sum(axis=1))[None, :] * (1 + 1e-9)
            low = scores - slack
            low[own_q, own_v] = -np.inf
            sure = np.partition(low, n - k, axis=1)[:, n - k]
            possible = scores + slack >= sure[:, None]
            if possible.mean() <= FEW:
                break
    possible[own_q, own_v] = False
    v = values.astype(kind)
    if possible.mean() <= FEW:
        rows, members = np.nonzero(possible)
        scores = (q[rows] * v[members]).sum(axis=1)
    else:
        every = q @ v.T
        if n > k:
            low = np.where(possible, every, -np.inf) if exact else np.where(possible, every, np.iinfo(np.int64).min)
            possible &= every >= np.partition(low, n - k, axis=1)[:, n - k][:, None]
        rows, members = np.nonzero(possible)
        scores = every[rows, members]
    order = np.lexsort((ids[members], -scores, rows))
    rows, members, scores = rows[order], members[order], scores[order]
    first = np.searchsorted(rows, rows, "left")
    best = np.arange(len(rows)) - first < k
    return query_ids[rows[best]], ids[members[best]], scores[best].astype(np.int64)


def build_index(vectors: DataFrame, per_block: int = VECTORS_PER_BLOCK) -> DataFrame:
    """(id, impacts) -> the index, written: a row per block with its vectors
    and their postings in impact order."""
    n = max(1, -(-vectors.count() // per_block))
    return materialize(_blocks(vectors, per_block, n), "topk-index")


def search(index: DataFrame, queries: DataFrame, k: int = 5, per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """Index blocks and queries (id, impacts) -> query_id, rank, vec_id,
    score: each query's k highest scores among the other ids (all, if fewer),
    ties to the smaller vec_id.  Repeated rows of a vec_id count each; queries
    alike in id and vector ask once, and those of one id with several vectors
    get their best together.  An empty table gives no rows."""
    asked = materialize(queries.select("id", "impacts").distinct(), "topk-queries")
    n = -(-asked.count() // per_block)
    if n == 0:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    packed = materialize(_blocks(asked, per_block, n), "topk-query-blocks")
    # a grid of about as many tiles as there are tasks; a block goes to the tiles of its row or column
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = min(packed.count(), max(1, round(tasks ** 0.5)))
    down = min(index.count(), -(-tasks // across))
    left = (index.withColumn("row", F.pmod(F.xxhash64("block"), F.lit(down)))
            .withColumn("tile", F.explode(F.sequence(F.col("row") * across, F.col("row") * across + across - 1))))
    right = (packed.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "values", "width")])
             .withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
             .withColumn("tile", F.col("row") * across + F.pmod(F.xxhash64("q_block"), F.lit(across))).drop("row"))
    parts = 4 * across * down  # few tiles share a task
    met = (left.repartition(parts, "tile").join(right.repartition(parts, "tile").hint("shuffle_merge"), "tile")
           .select("ids", "values", "width", "postings", "cuts", "q_ids", "q_values", "q_width"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, values, width, postings, cuts, q_ids, q_values, q_width = (batch.column(c)[i].as_py() for c in range(8))
                vec_ids, query_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                found = search_block(vec_ids, np.frombuffer(values, np.int64).reshape(len(vec_ids), width), np.frombuffer(postings, np.int32), cuts,
                                     query_ids, np.frombuffer(q_values, np.int64).reshape(len(query_ids), q_width), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    best = met.mapInArrow(meet, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    vectors = materialize(impacts(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "topk-impacts")
    return search(build_index(vectors), vectors.where("id % 50 = 0"))


OP3_SQL = """
WITH v AS (SELECT vec_id AS id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS i FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.i::DOUBLE[], c.i::DOUBLE[])::BIGINT AS score
      FROM (SELECT DISTINCT * FROM v WHERE id % 50 = 0) q JOIN v c ON q.id <> c.id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
