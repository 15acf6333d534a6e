"""Cells over a frame, and where in it the flow is strongest. Cells: cell_idx, box; means: segment_id, frame, cell_idx, mean."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Pixels of a side of the squares by which vectors and cells meet.
SQUARE = 16


def cells(spark: SparkSession, width: int, height: int, kind: str = "overlapping") -> DataFrame:
    """(cell_idx, box), column by column. ``even``: 5 by 5; ``fine``: a quarter of the frame every 7 pixels; ``overlapping``: 8 by 8 of a fifth by a quarter."""
    if kind == "even":
        w, h, dx, dy, nx, ny = width / 5, height / 5, width / 5, height / 5, 5, 5
    elif kind == "fine":
        w, h, dx, dy = width * 0.25, height * 0.25, 7, 7
        nx, ny = int((width - w) // dx) + 1, int((height - h) // dy) + 1
    else:
        w, h, nx, ny = width * 0.2, height * 0.25, 8, 8
        dx, dy = (width - w) / (nx - 1), (height - h) / (ny - 1)
    at = spark.range(nx * ny).select(F.col("id").cast("int").alias("cell_idx"), F.floor(F.col("id") / ny).alias("i"), (F.col("id") % ny).alias("j"))
    return at.select("cell_idx", S.box(F.col("i") * dx, F.col("j") * dy, F.lit(w), F.lit(h)).alias("box"))


def neighbours(grid: DataFrame, least_iou: float | None = None) -> DataFrame:
    """(cell_idx, neighbour): other cells that touch, or that overlap by more than ``least_iou``. The grid is a fixed small table."""
    a, b = grid.withColumnsRenamed({"box": "a"}), grid.select(F.col("cell_idx").alias("neighbour"), F.col("box").alias("b"))
    meets = S.touching(F.col("a"), F.col("b")) if least_iou is None else S.box_properties(F.col("a"), F.col("b"))["iou"] > least_iou
    return a.join(F.broadcast(b), (F.col("cell_idx") != F.col("neighbour")) & meets).select("cell_idx", "neighbour")


def cell_means(flow: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean magnitude of each cell. ``flow``: segment_id, frame, px, py, magnitude."""
    # A vector meets the cells over its square of the frame, and not all.
    x, y, w, h = (F.col(f"box.{c}") for c in "xywh")
    over = lambda low, size: F.explode(F.sequence(F.floor(low / SQUARE), F.floor((low + F.greatest(size, F.lit(0))) / SQUARE)))
    g = grid.withColumn("_sx", over(x, w)).withColumn("_sy", over(y, h))
    inside = (F.col("px") >= x) & (F.col("px") < x + w) & (F.col("py") >= y) & (F.col("py") < y + h)
    square = (F.floor(F.col("px") / SQUARE) == F.col("_sx")) & (F.floor(F.col("py") / SQUARE) == F.col("_sy"))
    return flow.join(F.broadcast(g), square & inside).groupBy("segment_id", "frame", "cell_idx").agg(F.avg("magnitude").alias("mean"))


def active_cells(means: DataFrame) -> DataFrame:
    """(segment_id, frame, cell_idx, amplitude): the cell with the largest positive mean, the first of equal ones; amplitude is what it has over the mean of all."""
    best = means.groupBy("segment_id", "frame").agg(F.max(F.struct("mean", -F.col("cell_idx"))).alias("m"), F.avg("mean").alias("average"))
    positive = F.col("m.mean") > 0
    return best.select("segment_id", "frame", F.when(positive, -F.col("m.col2")).otherwise(0).cast("int").alias("cell_idx"), (F.greatest(F.lit(0.0), F.col("m.mean")) - F.col("average")).alias("amplitude"))


def spatial_gradient(active: DataFrame, means: DataFrame, near: DataFrame) -> DataFrame:
    """Amplitude against the mean of the neighbours' own amplitudes."""
    average = means.groupBy("segment_id", "frame").agg(F.avg("mean").alias("average"))
    around = active.join(F.broadcast(near), "cell_idx").join(means.select("segment_id", "frame", F.col("cell_idx").alias("neighbour"), "mean"), ["segment_id", "frame", "neighbour"]).join(average, ["segment_id", "frame"])
    return around.groupBy("segment_id", "frame", "cell_idx", "amplitude").agg(F.abs(F.first("amplitude") - F.avg(F.col("mean") - F.col("average"))).alias("s_grad"))


def mean_amplitude(active: DataFrame) -> DataFrame:
    return active.groupBy("segment_id").agg(F.avg("amplitude").alias("avg_max_mag"))


def adaptive_threshold(active: DataFrame, share: float = 0.15) -> DataFrame:
    """Mean of a segment's top amplitudes; null where the share is less than one frame."""
    w = Window.partitionBy("segment_id")
    ranked = active.withColumns({"no": F.row_number().over(w.orderBy(F.desc("amplitude"), "frame")), "k": F.floor(F.round(F.count("*").over(w) * share, 9))})
    return ranked.groupBy("segment_id").agg(F.avg(F.when(F.col("no") <= F.col("k"), F.col("amplitude"))).alias("threshold"))


def cell_vectors(means: DataFrame) -> DataFrame:
    """Sorted cell means of each frame, as shares of the way from the mean to the largest."""
    m = means.groupBy("segment_id", "frame").agg(F.avg("mean").alias("average"), F.max("mean").alias("largest"), F.collect_list("mean").alias("all"))
    return m.select("segment_id", "frame", F.array_sort(F.transform("all", lambda v: F.try_divide(v - F.col("average"), F.col("largest") - F.col("average")))).alias("vector"))


def radial_points(spark: SparkSession, radius: float = 20.0, rings: int = 3, around: int = 8) -> DataFrame:
    """(sample, dx, dy): the centre and points on rings about it, every other ring turned by half a step."""
    ring = spark.range(rings * around).select((F.col("id") + 1).cast("int").alias("sample"), (F.floor(F.col("id") / around) + 1).alias("r"), (F.col("id") % around).alias("k"))
    turn = (F.col("k") + (F.col("r") % 2) / 2) * (2 * math.pi / around)
    far = F.col("r") * (radius / rings)
    # Rounded, as places are cut to whole numbers: a point on an axis must not fall short by a rounding error.
    points = ring.select("sample", F.round(far * F.cos(turn), 4).alias("dx"), F.round(far * F.sin(turn), 4).alias("dy"))
    return spark.range(1).select(F.lit(0).alias("sample"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")).unionByName(points)


def refine(active: DataFrame, grid: DataFrame, flow: DataFrame, points: DataFrame, width: int, height: int, least: float = 1.5, compat: bool = False, expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """For amplitudes above ``least``: the first point about the cell where the cell, moved there, has the largest mean.

    Means are compared to nine places, so that the order of summing decides nothing. Moved cells lie within the frame; where none has a positive mean, the cell stays (sample 0). ``compat`` counts
    the y of a moved cell from the cell's x. With ``expand``, a row of ``flow`` stands for many vectors: it adds px, py and
    magnitude where a row has met its cell, so that rows and not vectors are exchanged.
    """
    base = active.where(F.col("amplitude") > least).join(F.broadcast(grid), "cell_idx").select("segment_id", "frame", "cell_idx", "box")
    if expand is None:
        flow = flow.select("segment_id", "frame", "px", "py", "magnitude")
    # Never broadcast: flow grows with the frames, and Spark takes an exploded table to be as small as what it is made of.
    own = base.join(flow.hint("merge"), ["segment_id", "frame"], "left")
    own = own if expand is None else expand(own)
    x, y = F.col("box.x"), F.col("box.y")
    # 25 fixed points; sample 0 is the cell as it is.
    y0 = F.when(F.col("sample") == 0, y).otherwise(x) if compat else y
    at = S.box(x + F.col("dx"), y0 + F.col("dy"), F.col("box.w"), F.col("box.h"))
    inside = (F.col("px") >= at["x"]) & (F.col("px") < at["x"] + at["w"]) & (F.col("py") >= at["y"]) & (F.col("py") < at["y"] + at["h"])
    # A vector that lies in no moved cell has a null sample, which keeps its cell in the result and out of the choice.
    moved = own.join(F.broadcast(points), inside & S.inside_frame(at, width, height), "left")
    means = moved.groupBy("segment_id", "frame", "cell_idx", "sample").agg(F.round(F.avg("magnitude"), 9).alias("mean"))
    chosen = F.when(F.col("sample").isNotNull() & (F.col("mean") > 0), F.struct("mean", (-F.col("sample")).alias("turned")))
    best = means.groupBy("segment_id", "frame", "cell_idx").agg(F.max(chosen).alias("m"))
    return best.select("segment_id", "frame", "cell_idx", F.coalesce(-F.col("m.turned"), F.lit(0)).cast("int").alias("sample"), F.coalesce("m.mean", F.lit(0.0)).alias("mean"))
