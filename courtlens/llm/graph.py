"""Connected components of a graph that is held in tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, store


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the smallest node that it is connected with.

    Each round a node takes the smallest label among itself and its neighbours, then the label of its label, so
    that chains shrink by half. Rounds are written to the shared folder and end when no label changes.
    """
    both = store(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), f"{label}-edges")
    labels = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "node"), f"{label}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("l").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", "l", F.least("l", "near").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("l").alias("further"))
        new = store(met.join(jump, "m", "left").select("node", F.least("m", F.coalesce("further", "m")).alias("new"), "l"), f"{label}-labels")
        changed = new.where("new < l").limit(1).count()
        discard(labels)
        labels = new.select("node", F.col("new").alias("l"))
        labels._courtlens_path = new._courtlens_path
        if not changed:
            discard(both)
            out = labels.select("node", F.col("l").alias("component"))
            out._courtlens_path = labels._courtlens_path
            return out
