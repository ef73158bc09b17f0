"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as
Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``, and each works on all rows that its predecessor
kept.  Language and toxicity models are fitted on the rows of the stage's own
input whose labels may be used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.llm import langid, mixing, neardup, packing, toxicity
from terrascore.llm.shared import fold, unused
from terrascore.session import materialize

#: a text of whose trigrams the likeliest language holds less is in none
LEAST_LANGUAGE = 0.3


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that are text in one of the known languages; each row
    is judged by its own text, so NULL, empty and letterless texts go.  With no
    labelled text to learn from no row is kept; an empty table gives no rows."""
    filters = langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    name, share = unused(docs.columns, "lang_pred", "score")
    found = langid.identify(docs, filters, docs.columns, (name, share))
    return found.where((F.col(name) != langid.UNKNOWN) & (F.col(share) >= LEAST_LANGUAGE)).select(*docs.columns)


def clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that are not predicted toxic; each row is judged by its
    own text, also where doc_id is NULL.  NULL and empty texts stay; without
    labels of both kinds all rows do; an empty table gives no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold(F.col("doc_id"), 3) != 1)
    rated, named = unused(docs.columns, "score", "predicted")
    found = toxicity.score(docs, toxicity.fit(docs, labels), docs.columns, (rated, named))
    return found.where(F.col(named) == 0).select(*docs.columns)


def distinct(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates; rows that repeat
    a doc_id are one document, of which the row with the smallest text hash
    stays.  Rows without doc_id and wordless texts are in no class and stay;
    an empty table gives no rows."""
    found = neardup.near_duplicates(docs)
    own, = unused(docs.columns, "kept_id")
    ids = found.where("kept").select(F.col("doc_id").alias(own)).distinct()
    kept = materialize(docs.join(ids, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi"), "distinct-kept")
    again = materialize(kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"),
                        "distinct-again")
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    once = (kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64("text")).alias("row"))
            .select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents without an
    id are drawn one by one, by their texts.  NULL and empty texts have no
    words; NULL is a source of its own; an empty table gives no rows."""
    return mixing.mixed_rows(docs, key=[F.col("doc_id"), F.xxhash64("text")])


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences: a row per piece.  NULL and empty texts are a piece
    of one id; equal rows are packed one by one; an empty table gives no rows."""
    return packing.pack(packing.pieces(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language ID", language), ("toxicity", clean), ("near duplicates", distinct),
          ("source mix", mixed), ("packing", packed)]

#: the filters and the tokenizer can't be written in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
