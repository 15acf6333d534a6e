"""Groups of similar images, and the best image of each. Pairs: a, b, matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from .grouped import fold


def leader_clusters(pairs: DataFrame, nodes: DataFrame, least: int = 80) -> DataFrame:
    """(game_id, image_id, cluster): free images join the first free image that they match well.

    One fold for each game over its sparse list of matching pairs.
    """
    kept = pairs.where(F.col("matches") >= least).select("game_id", "a", "b")
    listed = nodes.select("game_id", F.col("image_id").alias("a"), F.lit(None).cast(nodes.schema["image_id"].dataType).alias("b"))

    def step(p: pd.DataFrame) -> pd.DataFrame:
        own = p[p["b"].notna()]
        found = folds.leader_clusters(sorted(p.loc[p["b"].isna(), "a"].astype("int64")), set(zip(own["a"].astype("int64"), own["b"].astype("int64"), strict=True)))
        return pd.DataFrame({"image_id": list(found), "cluster": list(found.values())})

    return fold(listed.unionByName(kept), ["game_id"], ["a"], step, "image_id long, cluster int")


def consecutive_clusters(pairs: DataFrame, least: int = 80) -> DataFrame:
    """(game_id, image_id, cluster): an image starts a new cluster unless it matches the one before. ``pairs``: image_id, matches with the one before."""
    order = Window.partitionBy("game_id").orderBy("image_id")
    starts = F.coalesce((F.col("matches") < least).cast("int"), F.lit(0))
    return pairs.select("game_id", "image_id", F.sum(starts).over(order).cast("int").alias("cluster"))


def cluster_sizes(clusters: DataFrame, most: int | None = None) -> DataFrame:
    """Sizes of clusters, the largest first; equal ones by number."""
    sizes = clusters.groupBy("game_id", "cluster").agg(F.count("*").alias("size"))
    if most is None:
        return sizes
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("size"), "cluster"))).where(F.col("rank") <= most)


def best_of_clusters(pairs: DataFrame, clusters: DataFrame, most: int = 2) -> DataFrame:
    """In each of the largest clusters, the image with the most matches to others of it; the first of equal ones."""
    c = clusters.select("game_id", "image_id", "cluster")
    inside = pairs.join(c.withColumnsRenamed({"image_id": "a", "cluster": "ca"}), ["game_id", "a"]).join(c.withColumnsRenamed({"image_id": "b", "cluster": "cb"}), ["game_id", "b"]).where("ca = cb")
    ends = inside.select("game_id", F.col("ca").alias("cluster"), F.explode(F.array("a", "b")).alias("image_id"), "matches")
    totals = ends.groupBy("game_id", "cluster", "image_id").agg(F.sum("matches").alias("total"))
    best = totals.groupBy("game_id", "cluster").agg(F.max(F.struct("total", -F.col("image_id"))).alias("m"))
    return best.select("game_id", "cluster", (-F.col("m.col2")).alias("image_id"), F.col("m.total").alias("total")).join(cluster_sizes(clusters, most).select("game_id", "cluster", "size"), ["game_id", "cluster"])


def merge_clusters(histograms: DataFrame, until: int = 3) -> DataFrame:
    """(game_id, id, members) after merging each game's closest histograms. Rows: game_id, candidate, histogram."""

    def step(p: pd.DataFrame) -> pd.DataFrame:
        held = {str(k): list(h) for k, h in zip(p["candidate"], p["histogram"], strict=True)}
        return pd.DataFrame(folds.merge_clusters(held, until), columns=["id", "members"])

    return fold(histograms, ["game_id"], ["candidate"], step, "id string, members int")


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(node, rank) after some rounds; ranks sum to 1, and nodes without ways out share theirs among all."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("ways"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    links = edges.join(out, "src")
    for _ in range(rounds):
        given = links.join(ranks, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") / F.col("ways")).alias("got"))
        lost = ranks.join(out, F.col("node") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        ranks = nodes.join(given, F.col("node") == F.col("to"), "left").crossJoin(F.broadcast(lost)).select("node", (F.lit((1 - damping) / max(1, n)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(1, n))).alias("rank"))
    return ranks
