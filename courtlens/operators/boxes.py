"""Tracked boxes: joins by frame and filters on their course."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import scalar as S
from .grouped import walk
from .ranges import within


def with_truth(frames: DataFrame, truth: DataFrame) -> DataFrame:
    """Frames with the true box of the same frame, if there is one."""
    return frames.join(truth.withColumnRenamed("box", "true_box"), ["game_id", "frame_number"], "left")


def frames_of_segments(frames: DataFrame, segments: DataFrame, bucket: int = 1024) -> DataFrame:
    """Frames within segments, joined by game and by stretches of ``bucket`` frames, so that no game meets itself whole."""
    return within(frames, segments, "frame_number", "start_frame", "end_frame", stretch=bucket)


def steady(boxes: DataFrame, most: float = 1.0) -> DataFrame:
    """Whether each box has kept its place since the frame before."""
    before = F.lag("box").over(Window.partitionBy("game_id").orderBy("frame_number"))
    return boxes.withColumn("steady", S.moved_less_than(F.col("box"), before, most))


def tracked(frames: DataFrame, reference: DataFrame, width: int, height: int, interval: int = 15) -> DataFrame:
    """(segment_id, frame, box) of a tracker that is started anew when it loses its box.

    ``frames`` (segment_id, frame, box, found): a tracker's box, null where it has lost it, and the box that a detector
    finds; reference: segment_id, ref. The tracker starts at the first valid detection, looked for every
    ``interval`` frames; where the box is lost, detections are looked for again from there on, and if there is none
    until the segment's end, the segment ends. A segment without a valid start has one row with frame -2 and no box.
    """
    ok = S.valid_box(F.col("found"), F.col("ref"), width, height)
    known = frames.join(reference, "segment_id").withColumn("starts", F.coalesce(ok, F.lit(False)))
    flat = known.select("segment_id", F.col("frame").cast("long").alias("frame"), "starts", *(F.col(f"{of}.{c}").alias(f"{of}_{c}") for of in ("box", "found") for c in "xywh"))

    def step(rows: list[tuple]):
        of = {row[0]: row for row in rows}
        first, last = rows[0][0], rows[-1][0]
        starts = lambda k: (row := of.get(first + k)) is not None and row[1]
        holds = lambda k: (row := of.get(first + k)) is not None and row[2] is not None
        path = folds.track(last - first, starts, holds, interval)
        for k, fresh in path:
            yield (first + k, *(of[first + k][6:] if fresh else of[first + k][2:6]))
        if not path:
            yield -2, None, None, None, None

    found = walk(flat, ["segment_id"], ["frame"], step, "frame long, x int, y int, w int, h int")
    return found.select("segment_id", "frame", F.when(F.col("x").isNotNull(), F.struct(*"xywh")).alias("box"))
