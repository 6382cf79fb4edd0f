"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scratch import cut, release


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of a table of links (a, b); component is the smallest node reachable.

    Each round every node takes the smallest label of its neighbours, and then its label's own label, which halves
    long chains. Rounds end when no label falls. Links and labels are tables in the shared folder, so a node of very
    many links meets them in joins whose partitions can be split; links themselves never leave the executors.
    """
    both = links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    both = cut(both.distinct(), "links")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        fallen = cut(near.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "fallen")
        of = fallen.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = cut(fallen.join(of, "label").select("node", F.col("next").alias("label"), "old"), "labels")
        settled = jumped.where("label < old").isEmpty()
        release(labels)
        release(fallen)
        labels = jumped
        if settled:
            release(both)
            return labels.select("node", F.col("label").alias("component"))
