"""Where the camera rests. Rows: game_id, idx, frame_number, motion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from .grouped import fold
from .ranges import within


def camera_candidates(motions: DataFrame, most_still: int = 30, compat: bool = True) -> DataFrame:
    def step(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(folds.camera_candidates(p["motion"].tolist(), most_still, compat), columns=["start_idx", "end_idx", "side"])

    return fold(motions, ["game_id"], ["idx"], step, "start_idx long, end_idx long, side string")


def first_candidates(candidates: DataFrame, n: int = 6) -> DataFrame:
    """The first n of each game, as the search stops there."""
    return candidates.withColumn("no", F.row_number().over(Window.partitionBy("game_id").orderBy("start_idx", "end_idx"))).where(F.col("no") <= n)


def simple_candidates(motions: DataFrame) -> DataFrame:
    return fold(motions, ["game_id"], ["idx"], lambda p: pd.DataFrame({"candidates": [folds.simple_candidates(p["motion"].tolist())]}), "candidates int")


def least_motion(candidates: DataFrame, flow: DataFrame) -> DataFrame:
    """The frame of least magnitude within each candidate; the first of equal ones."""
    met = within(flow, candidates, "idx", "start_idx", "end_idx")
    return met.groupBy("game_id", "start_idx", "end_idx").agg(F.min(F.struct("magnitude", "idx")).alias("m")).select("game_id", "start_idx", "end_idx", F.col("m.idx").alias("idx"), F.col("m.magnitude").alias("magnitude"))


def representatives(candidates: DataFrame) -> DataFrame:
    """First and last place of each candidate; sides as index 0 for right and 1 for left."""
    return candidates.select("game_id", F.when(F.col("side") == "RIGHT", 0).otherwise(1).alias("side_index"), F.explode(F.array("start_idx", "end_idx")).alias("idx")).distinct()
