"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text is split into sections at blank lines, sections into paragraphs at
line ends, paragraphs into leaves of up to eight words with their white
space; nothing is left out.  A leaf's digest is its MD5, a node's that of
its children's digests, so equal roots mean equal texts and a walk down
differing digests locates an edit.  The fingerprint is the root and the
first eight hex digits of every leaf; the likeness of two fingerprints is
the share of distinct leaves they have in common (Dice), 1 if their roots
are equal.

Everything is a column expression.  The next document is found with a lead
window over ranges of doc_id; a range's rows are followed by a copy of the
next range's first row, so texts are shuffled once and no task holds more
than a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascore.llm.shared import documents
from terrascore.session import materialize

LEAF = r"[\t-\r ]*(?:[^\t-\r ]+[\t-\r ]*){1,8}|[\t-\r ]+"
SHORT = 8


def leaves(text: Column) -> Column:
    """Sections of paragraphs of leaf digests."""
    return F.transform(F.split(text, "\n\n"), lambda section: F.transform(
        F.split(section, "\n"), lambda paragraph: F.transform(
            F.regexp_extract_all(paragraph, F.lit(LEAF), 0), F.md5)))


def digests(tree: Column) -> Column:
    """Leaf digests -> sections as (digest, paragraphs as (digest, leaves))."""
    paragraphs = lambda s: F.transform(s, lambda p: F.struct(F.md5(F.array_join(p, "")).alias("digest"), p.alias("leaves")))
    sections = F.transform(tree, paragraphs)
    return F.transform(sections, lambda s: F.struct(
        F.md5(F.array_join(F.transform(s, lambda p: p["digest"]), "")).alias("digest"), s.alias("paragraphs")))


def root(tree: Column) -> Column:
    """Digest of the whole tree."""
    section = F.transform(tree, lambda s: F.md5(F.array_join(F.transform(s, lambda p: F.md5(F.array_join(p, ""))), "")))
    return F.md5(F.array_join(section, ""))


def fingerprint(tree: Column) -> Column:
    short = F.transform(F.flatten(F.flatten(tree)), lambda x: F.substring(x, 1, SHORT))
    return F.concat_ws("/", root(tree), F.array_join(short, ""))


def _short(tree: Column) -> Column:
    return F.array_distinct(F.transform(F.flatten(F.flatten(tree)), lambda x: F.substring(x, 1, SHORT)))


def likeness(print_a: Column, print_b: Column, set_a: Column, set_b: Column) -> Column:
    both = F.size(F.array_intersect(set_a, set_b)) * F.lit(2.0)
    every = F.size(set_a) + F.size(set_b)
    return F.when(print_a == print_b, F.lit(1.0)).when(every == 0, F.lit(0.0)).otherwise(both / every)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, root, fingerprint, sections (the tree)."""
    tree = docs.select("doc_id", leaves(F.coalesce("text", F.lit(""))).alias("_t"))
    return tree.select("doc_id", root(F.col("_t")).alias("root"), fingerprint(F.col("_t")).alias("fingerprint"),
                       digests(F.col("_t")).alias("sections"))


def locate_edits(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Pairs of trees (columns of ``sections``) -> + edits: (section,
    paragraph, leaf) places from 0 in ``new`` whose digest differs from the
    one at the same place of ``old``; equal branches are not entered."""
    def leaf_edits(i, j, p, q):
        same = F.filter(F.transform(p["leaves"], lambda x, k: F.struct(
            i.cast("int").alias("section"), j.cast("int").alias("paragraph"), k.alias("leaf"),
            (~x.eqNullSafe(F.get(q["leaves"], k))).alias("_d"))), lambda e: e["_d"])
        return F.transform(same, lambda e: F.struct(e["section"], e["paragraph"], e["leaf"]))

    def paragraph_edits(i, s, o):
        return F.flatten(F.transform(s["paragraphs"], lambda p, j: F.when(
            p["digest"].eqNullSafe(F.get(o["paragraphs"], j)["digest"]), F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>"))
            .otherwise(leaf_edits(i, j, p, F.get(o["paragraphs"], j)))))

    return pairs.withColumn("edits", F.flatten(F.transform(F.col(new), lambda s, i: F.when(
        s["digest"].eqNullSafe(F.get(F.col(old), i)["digest"]), F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>"))
        .otherwise(paragraph_edits(i, s, F.get(F.col(old), i))))))


#: text of a range of documents, about
RANGE_BYTES = 64 << 20


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds above doc_id (they fall), by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(8, math.isqrt(len(bounds)))
    some = bounds[step - 1::step]

    def listed(values):  # one literal, however many bounds
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    every, coarse = listed(bounds), listed(some) if some else F.array().cast("array<bigint>")
    k = F.size(F.filter(coarse, lambda b: b > doc_id)) * step
    found = k + F.size(F.filter(F.slice(every, k + 1, step), lambda b: b > doc_id))
    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(found)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, text, next_text: the text of the next row in
    descending doc_id, NULL last, equal ids by their text's hash; after the
    last comes the first."""
    spark = docs.sparkSession
    if ranges is None:  # of about RANGE_BYTES, two a task at least
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    probabilities = [(i + 1) / ranges for i in range(ranges - 1)]
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), probabilities or [0.5], min(100 * ranges, 1_000_000))).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)  # at most one per range
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_range", _range_of(F.col("doc_id").cast("long"), bounds))
    before = [F.col("doc_id").desc_nulls_last(), F.col("_hash").asc()]

    key = F.struct((-F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63 + 1))).alias("k"), F.col("_hash").alias("h"))
    firsts = (rows.groupBy("_range").agg(F.min(key).alias("first")))  # one row per range
    order = Window.orderBy("_range")
    previous = F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy()))
    firsts = materialize(firsts.select(F.col("first.k").alias("_k"), F.col("first.h").alias("_hash"), previous.alias("_guest_of")), "next-firsts")
    guests = (rows.withColumn("_k", -F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63 + 1)))
              .join(F.broadcast(firsts), ["_k", "_hash"]).dropDuplicates(["_guest_of"])
              .select("doc_id", "text", "_hash", F.col("_guest_of").alias("_range"), F.lit(1).alias("_guest")))
    over = Window.partitionBy("_range").orderBy("_guest", *before)
    return (rows.withColumn("_guest", F.lit(0)).unionByName(guests)
            .withColumn("next_text", F.lead("text").over(over)).where("_guest = 0")
            .select("doc_id", "text", "next_text"))


def compared(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the
    next document.

    The edited text has its last third replaced by as many code points from
    the start of the next text (all, if that is shorter).  NULL text counts
    as empty; an empty table gives no rows; columns beside doc_id and text
    are not read.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    x = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), "text", "next_text",
        F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("edited"))
    x = x.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), leaves(F.col("text")).alias("a"),
                 leaves(F.col("edited")).alias("b"), leaves(F.col("next_text")).alias("c"))
    x = x.select("doc_id", "n_chars", "edited_sha256", *[f(F.col(t)).alias(name + t) for t in "abc"
                                                          for f, name in ((fingerprint, "print_"), (_short, "set_"))])
    near = lambda t: likeness(F.col("print_a"), F.col("print_" + t), F.col("set_a"), F.col("set_" + t))
    return x.select("doc_id", "n_chars", "edited_sha256", F.col("print_a").alias("fingerprint"),
                    F.col("print_b").alias("edited_fingerprint"), near("b").alias("near_edited"), near("c").alias("near_next"))


def op6_merkle(spark, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))


def _tree_sql(column: str) -> str:
    """Names of the digests' expressions over a text column."""
    return (f"[[[md5(x) FOR x IN regexp_extract_all(p, '{LEAF}')] FOR p IN string_split(s, chr(10))] "
            f"FOR s IN string_split({column}, chr(10) || chr(10))]")


_PRINT = ("concat(md5(array_to_string([md5(array_to_string([md5(array_to_string(p, '')) FOR p IN s], '')) FOR s IN {0}], '')), '/', "
          "array_to_string([x[1:8] FOR x IN flatten(flatten({0}))], ''))")
_NEAR = ("CASE WHEN print_a = print_{0} THEN 1.0::DOUBLE WHEN len(set_a) + len(set_{0}) = 0 THEN 0.0::DOUBLE "
         "ELSE 2.0::DOUBLE * len(list_intersect(set_a, set_{0})) / (len(set_a) + len(set_{0})) END")

OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), (SELECT max_by(t, doc_id) FROM d)) AS next FROM d),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 3) || substr(next, 1, length(t) // 3) AS edited FROM n),
l AS (SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_tree_sql('t')} AS a,
             {_tree_sql('edited')} AS b, {_tree_sql('next')} AS c FROM e),
f AS (SELECT doc_id, n_chars, edited_sha256, {', '.join(f"{_PRINT.format(x)} AS print_{x}, list_distinct([y[1:8] FOR y IN flatten(flatten({x}))]) AS set_{x}" for x in 'abc')} FROM l)
SELECT doc_id, n_chars, edited_sha256, print_a AS fingerprint, print_b AS edited_fingerprint,
       {_NEAR.format('b')} AS near_edited, {_NEAR.format('c')} AS near_next FROM f
"""
