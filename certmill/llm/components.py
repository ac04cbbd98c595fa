"""Connected components of an edge table, in rounds of joins; no component is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from certmill.plans.joins import lookup_join
from certmill.session import stored


def smallest_members(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of the component of each node of edges ``a, b``.

    A round gives each node the least label around it and then the label of its
    label, so distances halve. A node that many edges share is reduced by partial
    aggregation and looked up by a checked or spread join. Ends when no label changes.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        around = (
            lookup_join(both, labels.select(F.col("node").alias("b"), "label"), "b", "inner")
            .groupBy("a").agg(F.min("label").alias("around"))
        )
        nearer = labels.join(around.select(F.col("a").alias("node"), "around"), "node").select(
            "node", F.least("label", "around").alias("near"), F.col("label").alias("old")
        )
        nearer = stored(nearer, "labels-near")
        jump = nearer.select(F.col("node").alias("near"), F.col("near").alias("jump"))
        new = stored(lookup_join(nearer, jump, "near", "left").select("node", F.least("near", F.coalesce("jump", "near")).alias("label"), "old"), "labels")
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
