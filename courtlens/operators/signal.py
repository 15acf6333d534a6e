"""The side signal of a game: smoothing, windows, and bounds from its histogram. Rows: game_id, idx, frame_number, value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import scalar as S
from .grouped import fold


def game():
    """A game's samples in order."""
    return Window.partitionBy("game_id").orderBy("idx")



def signal_difference(signals: DataFrame) -> DataFrame:
    return signals.select("game_id", "idx", "frame_number", S.side_difference(F.col("l_matches"), F.col("r_matches")).alias("value"))


def _smoothed(df: DataFrame, how, keys=("game_id",), order=("idx",), column="value") -> DataFrame:
    kept = [c for c in df.columns if c not in keys and c != column]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    return fold(df, list(keys), list(order), lambda p: p[kept].assign(**{column: how(p[column].tolist())}), f"{schema}, {column} double")


def smooth(df: DataFrame, w: int = 5, **by) -> DataFrame:
    return _smoothed(df, lambda x: folds.smooth_in_place(x, w), **by)


def smooth_trailing(df: DataFrame, **by) -> DataFrame:
    return _smoothed(df, folds.smooth_trailing, **by)


def smooth_directions(df: DataFrame, **by) -> DataFrame:
    return _smoothed(df, folds.smooth_directions, **by)


def smooth_pair(signals: DataFrame, w: int = 5) -> DataFrame:
    """Centred means of both match counts, cut to whole numbers; places outside the series count as its ends."""
    near = game().rowsBetween(-w, w)
    whole = Window.partitionBy("game_id")
    before, after = F.greatest(F.lit(0), w - F.col("idx")), F.greatest(F.lit(0), F.col("idx") + w - (F.count("*").over(whole) - 1))

    def mean(c: str) -> Column:
        total = F.sum(c).over(near) + before * F.min_by(c, "idx").over(whole) + after * F.max_by(c, "idx").over(whole)
        return (total / (2 * w + 1)).cast("int")

    return signals.select("game_id", "idx", "frame_number", mean("l_matches").alias("l_matches"), mean("r_matches").alias("r_matches"))


def gradient(df: DataFrame, column: str = "value", window=None) -> DataFrame:
    """Central differences, at the ends the one there is; a single value is its own gradient."""
    window = window or game()
    before, after, here = F.lag(column).over(window), F.lead(column).over(window), F.col(column)
    central = F.when(before.isNull() & after.isNull(), here).otherwise(F.abs(F.coalesce(before, here) - F.coalesce(after, here)))
    return df.withColumn("gradient", central)


def first_difference(df: DataFrame, column: str = "value", window=None) -> DataFrame:
    window = window or game()
    return df.withColumn("difference", F.coalesce(F.abs(F.col(column) - F.lag(column).over(window)), F.lit(0.0)))


def running_sums(df: DataFrame, window=None) -> DataFrame:
    """``agg_max``: running sum of the value; ``agg_grad``: the first gradient, then the sum of its steps."""
    window = window or game()
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.abs(F.col("gradient") - F.lag("gradient").over(window)), F.col("gradient"))
    return df.withColumn("step", step).withColumns({"agg_max": F.sum("value").over(upto), "agg_grad": F.sum("step").over(upto)}).drop("step")


def ahead_difference(df: DataFrame, by: int = 5, window=None) -> DataFrame:
    window = window or game()
    return df.withColumn("ahead", F.lead("value", by).over(window) - F.col("value"))


def mean_ahead(df: DataFrame, n: int = 7, least: float = 2.0) -> DataFrame:
    """Whether the mean of the next n samples reaches ``least``; windows end with the series."""
    return df.withColumn("mean_ahead", F.avg("value").over(game().rowsBetween(1, n))).withColumn("stays_positive", F.col("mean_ahead") >= least)


def all_outside_band(df: DataFrame, fraction: float, offset: float, n: int = 3) -> DataFrame:
    outside = (S.side_in_band(F.col("value"), fraction, offset) != "MID").cast("int")
    return df.withColumn("outside", outside).withColumn("continuous", F.min("outside").over(game().rowsBetween(0, n - 1)) == 1).drop("outside")


def none_on_side(df: DataFrame, side: str, fraction: float, offset: float, n: int = 5) -> DataFrame:
    """Whether none of the next n samples lies on a side, and how many were looked at before one did (n - 1 at most)."""
    on = F.when(S.side_in_band(F.col("value"), fraction, offset) == side, F.col("idx"))
    first = F.min("on").over(game().rowsBetween(0, n - 1))
    return df.withColumn("on", on).withColumn("step", F.coalesce(first - F.col("idx"), F.lit(n - 1)).cast("int")).withColumn("none", first.isNull()).drop("on")


def histogram_bounds(df: DataFrame, default_low: float = -1.0, default_high: float = 1.0, width: int = 10, bins: int = 10, drop: int = 90) -> DataFrame:
    """(game_id, low, high) where the counts of |value| fall by more than ``drop`` from one bin to the next, looked for from the last bin."""
    positive = F.col("value") >= 0
    bin_ = F.least(F.floor(F.abs(F.col("value").cast("int")) / width), F.lit(bins - 1)).cast("int")
    counts = df.groupBy("game_id", positive.alias("positive"), bin_.alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.select("game_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("positive", F.explode(F.array(F.lit(True), F.lit(False))))
    full = all_bins.join(counts, ["game_id", "positive", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fallen = full.withColumn("fall", F.lag("n").over(Window.partitionBy("game_id", "positive").orderBy("bin")) - F.col("n")).where(F.col("fall") > drop)
    picked = fallen.groupBy("game_id").agg(F.max(F.when(F.col("positive"), F.col("bin"))).alias("p"), F.max(F.when(~F.col("positive"), F.col("bin"))).alias("m"))
    return df.select("game_id").distinct().join(picked, "game_id", "left").select("game_id", F.coalesce(-width * F.col("m"), F.lit(default_low)).cast("double").alias("low"), F.coalesce(width * F.col("p"), F.lit(default_high)).cast("double").alias("high"))


def value_bounds(df: DataFrame) -> DataFrame:
    """(game_id, low, high): least and largest value cut to whole numbers, 0 included."""
    cut = F.col("value").cast("int")
    return df.groupBy("game_id").agg(F.least(F.lit(0), F.min(cut)).alias("low"), F.greatest(F.lit(0), F.max(cut)).alias("high"))


def normalise(df: DataFrame, bounds: DataFrame, mode: int, clamped: bool = False) -> DataFrame:
    how = S.normalise_clamped if clamped else S.normalise
    return df.join(bounds, "game_id").withColumn("value", how(F.col("value"), F.col("low").cast("double"), F.col("high").cast("double"), mode)).drop("low", "high")


def still_sides(motions: DataFrame) -> DataFrame:
    """Resting samples take the side of the last move, or the opposite of the next one where there is none before."""
    moved = F.when(F.col("motion") != "STILL", F.col("motion"))
    before = F.last(moved, ignorenulls=True).over(game().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(moved, ignorenulls=True).over(game().rowsBetween(1, Window.unboundedFollowing))
    side = F.when(before.isNotNull(), F.when(before == "MOVINGRIGHT", "RIGHT").otherwise("LEFT")).when(after.isNotNull(), F.when(after == "MOVINGLEFT", "RIGHT").otherwise("LEFT"))
    return motions.withColumn("side", F.when(F.col("motion") == "STILL", side))


def inherited_sides(motions: DataFrame) -> DataFrame:
    return fold(motions, ["game_id"], ["idx"], lambda p: p[["idx", "frame_number", "motion"]].assign(side=folds.inherited_sides(p["motion"].tolist())), "idx long, frame_number long, motion string, side string")


def empty(columns: dict) -> pd.DataFrame:
    return pd.DataFrame({k: pd.Series(dtype=t) for k, t in columns.items()})
