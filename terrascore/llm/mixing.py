"""Mixing sources to target weights by Pareto order sampling.

Targets.  Sources share ``share`` times all words by weight; no target
passes ``max_copies`` times its source's size, and the excess is shared
again by weight until none is above.  Sorted by size per weight, the capped
sources are a prefix, so running sums over the source table find the level
without a loop.

Sampling.  A source whose target is m times its size takes floor(m) whole
copies of every document.  The fraction that is left is a Pareto sample of
fixed size in words with unequal chances: a document's chance p grows with the
root of its size (long documents carry more of a source, yet less than in
proportion), scaled so that the words expected are the words wanted.  Documents
are ranked by u/(1-u), with u uniform, over their inclusion odds p/(1-p) (times
``odds_col`` if given), and
taken in that order up to the rank whose running sum is nearest the words
wanted.  If words are still missing, the one document whose size fits them
best is taken as well, so a source misses its target by less than one
document.

A source may hold any share of the rows: running sums come from
``prefix_sum``, which splits a hot source over ranges, and only one row per
source is joined back.  Everything runs on the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.llm.shared import SPACED_WORD, join_counted, uniform
from terrascore.operators.ranks import prefix_sum
from terrascore.session import materialize

SEED = 7


def n_words(text: Column) -> Column:
    """Number of words; NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, weights=(3, 1, 2)) -> DataFrame:
    """``weight`` by place of the source in code point order, NULL last.  One
    row per source: a list of sources is short beside the documents."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    return sources.withColumn("weight", pick)


def targets(sources: DataFrame, share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """(source, source_size, weight) -> + target: words wanted of each source."""
    cap = F.col("source_size") * max_copies
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    x = sources.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    x = x.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share))
                                - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    # the level of the first source that stays below its cap holds for all
    first = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))).over(everything)
    x = x.withColumn("_first", first)
    return x.withColumn("target", F.when(F.col("_first").isNull(), F.col("_cap").cast("double"))
                        .otherwise(F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_first._level")))
                        ).drop("_cap", "_ratio", "_level", "_first")


def mix(docs: DataFrame, weights=cycle_weights, share: float = 1.5, max_copies: int = 2,
        seed: int = SEED, odds_col: str | None = None, key: Sequence[Column] | None = None) -> DataFrame:
    """Documents (doc_id, text, source, ...) -> the same rows with ``size``,
    ``source_size``, ``target``, ``copies`` and ``taken`` = copies * size.

    ``weights`` adds the column weight (> 0) to the table of sources.
    NULL text has size 0; NULL is a source of its own.  Rows with the same
    doc_id (or ``key``, if given) and source are taken alike.  An empty table gives no rows.  Other
    columns pass through; one called like an output column is replaced.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*made)
    sized = docs.withColumn("size", n_words(F.col("text")))
    u = uniform(seed, *(key or [F.col("doc_id")]))
    odds = (F.coalesce(F.col(odds_col).cast("double"), F.lit(1.0)) if odds_col else F.lit(1.0))
    draw = u / (F.lit(1.0) - u) / odds
    rows = materialize(sized.select("source", "size", draw.alias("_draw")), "mix-sizes")

    # whole numbers, so that their sums don't depend on the order
    heft = F.floor(F.col("size") * F.sqrt(F.col("size").cast("double"))).cast("long")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(heft).alias("source_heft"))
    plan = materialize(
        targets(weights(sources), share, max_copies)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                    .otherwise(0).cast("int"))
        .withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        # a document's chance over the root of its size: chances times sizes add up to the words wanted
        .withColumn("scale", F.when(F.col("wanted") > 0, F.col("wanted") / F.col("source_heft"))), "mix-plan")

    def order(scale: Column, size: Column, drawn: Column) -> Column:
        """Pareto order: random odds over inclusion odds; wordless documents have none."""
        chance = F.least(F.lit(0.999), scale * F.sqrt(size.cast("double")))
        return F.when(size > 0, drawn / (chance / (F.lit(1.0) - chance)))


    keyed = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    ranked = (join_counted(keyed, plan.where("scale IS NOT NULL").select("source_key", "scale", "wanted"), ["source_key"])
              .withColumn("_q", order(F.col("scale"), F.col("size"), F.col("_draw"))).where("_q IS NOT NULL")
              .groupBy("source_key", "wanted", "_q").agg(F.sum("size").alias("size")))
    cum = materialize(prefix_sum(materialize(ranked, "mix-ranked"), ["_q"], ["size"], ["source_key", "wanted"], native=True), "mix-cum")

    gap = F.abs(F.col("size_cum") - F.col("wanted"))
    cut = (cum.groupBy("source_key", "wanted").agg(F.min(F.struct(gap.alias("gap"), F.col("_q").alias("q"),
                                                                  F.col("size_cum").alias("sum"))).alias("best"))
           .select("source_key", "wanted",
                   # taking none is nearer than the first document if that overshoots by more
                   F.when(F.col("best.gap") < F.col("wanted"), F.col("best.q")).alias("cut"),
                   (F.col("wanted") - F.when(F.col("best.gap") < F.col("wanted"), F.col("best.sum")).otherwise(0)).alias("missing")))
    cut = materialize(cut, "mix-cut")
    # the one document beyond the cut that brings the sum nearest
    left = (join_counted(cum, cut.select("source_key", "cut", "missing"), ["source_key"])
            .where((F.col("cut").isNull() | (F.col("_q") > F.col("cut"))) & (F.abs(F.col("missing") - F.col("size")) < F.col("missing"))))
    extra = (left.groupBy("source_key")
             .agg(F.min(F.struct(F.abs(F.col("missing") - F.col("size")).alias("gap"), F.col("_q").alias("q"))).alias("e"))
             .select("source_key", F.col("e.q").alias("extra")))
    decided = materialize(plan.join(cut.select("source_key", "cut"), "source_key", "left").join(extra, "source_key", "left")
                          .select("source_key", "source_size", "target", "whole", "scale", "cut", "extra"), "mix-decided")

    named = decided.select(*[F.col(c).alias("_m_" + c) for c in decided.columns])
    big = sized.withColumn("_m_source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    q = order(F.col("_m_scale"), F.col("size"), draw)
    more = F.coalesce(q <= F.col("_m_cut"), F.lit(False)) | F.coalesce(q == F.col("_m_extra"), F.lit(False))
    copies = F.col("_m_whole") + more.cast("int")
    return (join_counted(big, named, ["_m_source_key"])
            .select(*docs.columns, "size", F.col("_m_source_size").alias("source_size"),
                    F.col("_m_target").alias("target"), copies.alias("copies"),
                    (copies * F.col("size")).cast("long").alias("taken")))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it has copies, with its
    own columns, whatever their names."""
    used = ["doc_id", "text", "source"]
    rest = [c for c in docs.columns if c not in used]
    own = docs.select(*used, F.struct(*rest).alias("_rest")) if rest else docs
    mixed = (mix(own, **options).where("copies > 0")
             .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
    return mixed.select(*[F.col(c) if c in used else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(floor(size * sqrt(size::DOUBLE))::BIGINT)::BIGINT AS source_heft FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
r AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio > level),
t AS (SELECT source, source_size, source_heft, CASE WHEN (SELECT level FROM f) IS NULL THEN cap::DOUBLE
             ELSE least(cap::DOUBLE, weight * (SELECT level FROM f)) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
p2 AS (SELECT *, target - (whole * source_size)::DOUBLE AS wanted FROM p),
p3 AS (SELECT *, CASE WHEN wanted > 0 THEN wanted / source_heft END AS scale FROM p2),
x AS (SELECT d.doc_id, d.size, d.source, p3.source_size, p3.target, p3.whole, p3.wanted,
             CASE WHEN d.size > 0 THEN ((d.u / (1.0::DOUBLE - d.u)) / 1.0::DOUBLE)
                  / (least(0.999::DOUBLE, scale * sqrt(d.size::DOUBLE)) / (1.0::DOUBLE - least(0.999::DOUBLE, scale * sqrt(d.size::DOUBLE)))) END AS q
      FROM d JOIN p3 ON d.source IS NOT DISTINCT FROM p3.source),
c AS (SELECT source, wanted, q, size, sum(size) OVER (PARTITION BY source ORDER BY q) AS cum
      FROM (SELECT source, wanted, q, sum(size) AS size FROM x WHERE q IS NOT NULL GROUP BY ALL)),
b AS (SELECT source, wanted, min(row(abs(cum::DOUBLE - wanted), q, cum::DOUBLE)) AS best FROM c GROUP BY source, wanted),
k AS (SELECT source, CASE WHEN best[1] < wanted THEN best[2] END AS cut,
             wanted - CASE WHEN best[1] < wanted THEN best[3] ELSE 0 END AS missing FROM b),
e AS (SELECT c.source, min(row(abs(k.missing - c.size), c.q))[2] AS extra
      FROM c JOIN k ON c.source IS NOT DISTINCT FROM k.source
      WHERE (k.cut IS NULL OR c.q > k.cut) AND abs(k.missing - c.size) < k.missing GROUP BY c.source)
SELECT x.doc_id, x.size, x.source_size, x.target,
       (x.size * (x.whole + CASE WHEN coalesce(x.q <= k.cut, false) OR coalesce(x.q = e.extra, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x LEFT JOIN k ON x.source IS NOT DISTINCT FROM k.source LEFT JOIN e ON x.source IS NOT DISTINCT FROM e.source
"""
