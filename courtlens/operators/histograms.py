"""Histograms of pixels and their means. Pixels: image_id, px, py and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Cell size of the edge histogram, and bins of luma and the two chroma channels.
EDGE_CELL = (128, 72)
COLOUR_BINS = (8, 12, 12)


def edge_counts(edges: DataFrame, cell: tuple[int, int] = EDGE_CELL) -> DataFrame:
    """Edge pixels by cell of the frame. ``edges``: image_id, px, py, edge (0: none)."""
    return edges.where("edge <> 0").groupBy("image_id", F.floor(F.col("px") / cell[0]).cast("int").alias("cx"), F.floor(F.col("py") / cell[1]).cast("int").alias("cy")).agg(F.count("*").alias("n"))


def colour_histogram(pixels: DataFrame, bins: tuple[int, int, int] = COLOUR_BINS, low: float = 0.0, high: float = 256.0) -> DataFrame:
    """(image_id, bin, n) of the joint histogram of y, cb and cr; ``bin`` is null for pixels in no bin."""
    at = [S.first_bin(F.col(c), F.lit(low), F.lit((high - low) / n), n) for c, n in zip(("y", "cb", "cr"), bins, strict=True)]
    return pixels.groupBy("image_id", ((at[0] * bins[1] + at[1]) * bins[2] + at[2]).alias("bin")).agg(F.count("*").alias("n"))


def mean_histograms(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise mean of the ``histogram`` arrays of each group."""
    each = histograms.select(*keys, F.posexplode("histogram").alias("at", "v")).groupBy(*keys, "at").agg(F.avg("v").alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("histogram"))
