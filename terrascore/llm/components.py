"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascore.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of long ids -> (id, label): the smallest id reachable,
    for every id that has an edge.

    Each round every id takes the smallest label among its neighbours', then
    the label of its label.  Labels only fall, and jumping halves the way
    left, so chains end in a logarithmic number of rounds.  All rounds are
    joins and partial aggregates over written tables; a hub with many
    neighbours is one row of labels joined to many edges, which AQE splits.
    """
    both = materialize(edges.select("a", "b").where("a <> b")
                       .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
                       .distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n"))
                         .select("id", F.least("id", "n").alias("label")), "cc-labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("n")))
        low = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "n").alias("label"))
        low = materialize(low, "cc-low")
        up = low.select(F.col("id").alias("label"), F.col("label").alias("top"))
        labels = materialize(low.join(up, "label", "left")
                             .select("id", "old", F.least("label", F.coalesce("top", "label")).alias("label")), "cc-labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("id", "label")
        labels = labels.select("id", "label")
