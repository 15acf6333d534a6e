"""When a ball reaches the board. Rows: segment_id, idx, frame, amplitude, agg_max, agg_grad."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from . import signal
from .grouped import fold


def segment():
    """A segment's frames in order."""
    return Window.partitionBy("segment_id").orderBy("idx")



def amplitude_features(active: DataFrame, w: int = 2) -> DataFrame:
    """Smoothed amplitude with its gradient and running sums."""
    s = active.withColumn("idx", (F.row_number().over(Window.partitionBy("segment_id").orderBy("frame")) - 1).cast("long")).withColumnRenamed("amplitude", "value")
    s = signal.smooth(s.select("segment_id", "idx", "frame", "value"), w, keys=("segment_id",))
    return signal.running_sums(signal.gradient(s, window=segment()), window=segment()).withColumnRenamed("value", "amplitude")


def windows(series: DataFrame) -> DataFrame:
    """Windows of 20 rows (30 from 150 rows on) at every half of that, with what the two running sums gain in them."""
    n = F.count("*").over(Window.partitionBy("segment_id"))
    s = series.withColumn("size", F.when(n < 150, 20).otherwise(30))
    for size in (20, 30):
        s = s.withColumns({f"{c}_{size}": F.lead(c, size).over(segment()) for c in ("agg_max", "agg_grad", "frame")})
    pick = lambda c: F.when(F.col("size") == 20, F.col(f"{c}_20")).otherwise(F.col(f"{c}_30"))
    out = s.where((F.col("idx") % F.floor(F.col("size") / 2) == 0) & pick("agg_max").isNotNull())
    out = out.select("segment_id", "idx", "size", F.col("frame").alias("start_frame"), pick("frame").alias("end_frame"), (pick("agg_max") - F.col("agg_max")).alias("gain_max"), (pick("agg_grad") - F.col("agg_grad")).alias("gain_grad"))
    # One window alone is none.
    return out.withColumn("n", F.count("*").over(Window.partitionBy("segment_id"))).where("n >= 2").drop("n")


def split_windows(found: DataFrame, f: float = 1.5, apart: float = 0.4) -> DataFrame:
    """The smaller of two clusters of a segment's windows, if the clusters differ enough in size and in strength."""

    def step(p: pd.DataFrame) -> pd.DataFrame:
        labels, centres = folds.two_means(list(zip(p["gain_max"], p["gain_grad"], strict=True)))
        n1 = sum(labels)
        n0 = len(labels) - n1
        norms = [(a * a + b * b) ** 0.5 for a, b in centres]
        largest = max(norms)
        ok = min(n0, n1) * f < max(n0, n1) and min(n0, n1) > 0 and largest > 0 and abs(norms[0] - norms[1]) / largest > apart
        small = 0 if n0 < n1 else 1
        return p[["idx", "size", "start_frame", "end_frame"]][[bool(ok and k == small) for k in labels]]

    return fold(found, ["segment_id"], ["idx"], step, "idx long, size int, start_frame long, end_frame long")


def merge_windows(selected: DataFrame) -> DataFrame:
    """Windows that overlap become one; those that only touch stay apart."""
    order = Window.partitionBy("segment_id").orderBy("start_frame", "end_frame")
    s = selected.withColumn("before", F.lag("end_frame").over(order)).withColumn("new", F.coalesce((F.col("before") <= F.col("start_frame")).cast("int"), F.lit(1)))
    s = s.withColumn("island", F.sum("new").over(order))
    return s.groupBy("segment_id", "island").agg(F.min("start_frame").alias("start_frame"), F.max_by("end_frame", F.struct("start_frame", "end_frame")).alias("end_frame"), F.min("idx").alias("idx"), F.max("size").alias("size")).drop("island")


def strongest_moment(merged: DataFrame, series: DataFrame, step: int = 5, compat: bool = True) -> DataFrame:
    """(segment_id, frame): a third into the part of each merged window where the running amplitude gains most.

    ``compat`` looks the gains up from the segment's start on in each window; else from the window's own place.
    """
    w = merged.withColumn("at", F.explode(F.sequence("start_frame", F.greatest("start_frame", F.col("end_frame") - F.col("size")), F.lit(step).cast("long"))))
    w = w.withColumn("place", (F.col("at") - F.col("start_frame")) + (F.lit(0) if compat else F.col("idx")))
    s = series.select("segment_id", F.col("idx").alias("place"), "agg_max")
    here = w.join(s, ["segment_id", "place"]).withColumn("place", F.col("place") + F.col("size")).join(s.withColumnRenamed("agg_max", "later"), ["segment_id", "place"])
    best = here.groupBy("segment_id", "start_frame", "end_frame", "size").agg(F.max(F.struct(F.col("later") - F.col("agg_max"), -F.col("at"))).alias("m"))
    return best.select("segment_id", (-F.col("m.col2") + F.floor(F.col("size") / 3)).cast("long").alias("frame"))


def with_missing(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """A row of -1 for each segment without an entry."""
    none = segments.select("segment_id").distinct().join(entries, "segment_id", "left_anti").withColumn("frame", F.lit(-1).cast("long"))
    return entries.select("segment_id", "frame").unionByName(none)


def entry_runs(active: DataFrame, thresholds: DataFrame, run: int = 5, apart: int = 90) -> DataFrame:
    """(segment_id, frame) by runs of strong frames at one place. ``active`` has a box."""

    def step(p: pd.DataFrame) -> pd.DataFrame:
        t = p["threshold"].iloc[0]
        boxes = [(b["x"], b["y"], b["w"], b["h"]) for b in p["box"]]
        found = folds.ball_entries(p["frame"].tolist(), p["amplitude"].tolist(), boxes, float("inf") if pd.isna(t) else t, run, apart)
        return pd.DataFrame({"frame": pd.Series(found, dtype="int64")})

    return fold(active.join(thresholds, "segment_id"), ["segment_id"], ["frame"], step, "frame long")
