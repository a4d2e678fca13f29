"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.plans.sizing import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node of the edges (``a``, ``b``).

    Each round takes the smallest label among a node and its neighbours, then follows labels
    once, so distances halve; labels are written to the shared folder after each round and those before removed. Only a
    count of changed labels comes to the driver.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialize(
        both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("component")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy("a")
            .agg(F.min("component").alias("least"))
        )
        lowered = materialize(
            labels.join(near.withColumnRenamed("a", "node"), "node").select(
                "node", F.col("component").alias("old"), F.least("component", "least").alias("component")
            ),
            "lowered",
        )
        release(labels)
        onward = lowered.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = materialize(
            lowered.join(onward, "component").select("node", "old", F.col("next").alias("component")), "labels"
        )
        release(lowered)
        if labels.where("old <> component").limit(1).count() == 0:
            release(both)
            return labels.select("node", "component")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of more ``edges`` (``a``, ``b``) beside those that ``labels`` are the components of.

    Edges are led between components, named by their smallest nodes, so only what they join is gone through again.
    """
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    ends = edges.select("a", "b").join(known, "a", "left").join(known.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    between = materialize(
        ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "between"
    )
    if between.limit(1).count() == 0:
        release(between)
        return labels
    joined = components(between)
    release(between)
    new = joined.join(labels, "node", "left_anti").select("node", "component")
    onward = joined.select(F.col("node").alias("component"), F.col("component").alias("next"))
    moved = labels.join(onward, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return materialize(moved.union(new), "labels")
