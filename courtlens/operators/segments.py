"""From a smoothed side signal to plays: sign runs, their validation, thresholds and markers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from .grouped import fold
from .ranges import within
from .signal import game

SEGMENT = "start_frame long, end_frame long, side string, length int"


def sign_runs(df: DataFrame, strict: bool = True) -> DataFrame:
    """(game_id, run_id, start_idx, end_idx, is_positive, max_mag, min_mag, auc): stretches of one sign, as islands.

    ``strict`` keeps the finer points of the definition: extremes leave out a run's first sample (but for the first
    run), the area is cut to a whole number at each step and takes the next run's first sample, and a last run of one
    sample is lost.
    """
    sign = df.withColumn("positive", F.col("value") >= 0)
    change = sign.withColumn("change", (F.col("positive") != F.lag("positive").over(game())).cast("int"))
    run = change.withColumn("run_id", F.coalesce(F.sum("change").over(game().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int"))
    run = run.withColumn("next", F.lead("value").over(game())).withColumn("last_idx", F.max("idx").over(Window.partitionBy("game_id")))
    inner = (F.coalesce(F.col("change"), F.lit(0)) == 0) if strict else F.lit(True)
    whole = F.col("value").cast("int")
    runs = run.groupBy("game_id", "run_id").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.first("positive").alias("is_positive"), F.max("last_idx").alias("last_idx"),
        F.greatest(F.lit(0.0), F.max(F.when(inner, F.col("value")))).alias("max_mag"), F.least(F.lit(0.0), F.min(F.when(inner, F.col("value")))).alias("min_mag"),
        F.coalesce(F.sum(F.when(inner & (F.col("idx") > 0), whole)), F.lit(0)).alias("area"), F.max_by("next", "idx").alias("next"),
    )
    area = F.abs((F.col("area") + F.coalesce("next", F.lit(0.0))).cast("int")) if strict else F.abs(F.col("area")).cast("int")
    if strict:
        runs = runs.where(~((F.col("start_idx") == F.col("last_idx"))))
    return runs.select("game_id", "run_id", "start_idx", "end_idx", "is_positive", "max_mag", "min_mag", area.alias("auc"))


def run_means(runs: DataFrame) -> DataFrame:
    """Mean magnitude and area of each sign's runs."""
    size = F.when(F.col("is_positive"), F.col("max_mag")).otherwise(-F.col("min_mag"))
    return runs.groupBy("game_id", "is_positive").agg(F.avg(size).alias("avg_mag"), F.avg("auc").alias("avg_auc"), F.count("*").alias("n_runs"))


def validate_runs(runs: DataFrame) -> DataFrame:
    kept = ["run_id", "start_idx", "end_idx", "is_positive", "max_mag", "min_mag", "auc"]

    def step(p: pd.DataFrame) -> pd.DataFrame:
        size = p["max_mag"].where(p["is_positive"], -p["min_mag"])
        return p[kept].assign(valid=folds.valid_runs(p["is_positive"].tolist(), size.tolist()))

    return fold(runs, ["game_id"], ["run_id"], step, "run_id int, start_idx long, end_idx long, is_positive boolean, max_mag double, min_mag double, auc int, valid boolean")


def normalise_runs(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Samples of runs by their run's largest magnitude: (game_id, run_id, idx, frame_number, value)."""
    r = runs.select("game_id", "run_id", "start_idx", "end_idx", "is_positive", "max_mag", "min_mag")
    joined = within(df, r, "idx", "start_idx", "end_idx")
    by = F.when(F.col("is_positive"), F.col("max_mag")).otherwise(F.abs("min_mag"))
    return joined.select("game_id", "run_id", "idx", "frame_number", "is_positive", F.coalesce(F.try_divide("value", by), F.lit(0.0)).alias("value"))


def threshold_segments(normalised: DataFrame, enter: float = 0.5, leave: float = 0.3) -> DataFrame:
    """One segment for each run of normalised samples: what :func:`folds.crossing` finds, as windows and one aggregate.

    A run starts at the first value above ``enter`` that exceeds the one before, and ends at the last value above
    ``leave`` that exceeds the one behind it; behind the last one counts what was looked at before the start was found.
    """
    order = Window.partitionBy("game_id", "run_id").orderBy("idx")
    a = F.abs("value")
    n = normalised.withColumns({"a": a, "before": F.coalesce(F.lag(a).over(order), F.lit(0.0)), "behind": F.lead(a).over(order)})
    enters = (F.col("a") > enter) & (F.col("a") > F.col("before"))
    leaves = F.col("behind").isNotNull() & (F.col("a") > leave) & (F.col("a") > F.col("behind"))
    frame = F.col("frame_number").cast("long")
    runs = n.groupBy("game_id", "run_id").agg(
        F.min(F.when(enters, F.struct("idx", frame.alias("frame"), "before"))).alias("hit"), F.max(F.when(leaves, frame)).alias("leaving"),
        F.min(frame).alias("first"), F.max(F.struct("idx", frame.alias("frame"), "a")).alias("last"), F.bool_or("is_positive").alias("positive"),
    )
    carried = F.coalesce("hit.before", "last.a")
    end = F.when((F.col("last.a") > leave) & (F.col("last.a") > carried), F.col("last.frame")).otherwise(F.coalesce("leaving", "last.frame"))
    found = runs.select("game_id", "run_id", F.coalesce("hit.frame", "first").alias("start_frame"), end.alias("end_frame"), F.when(F.col("positive"), "L").otherwise("R").alias("side"))
    return found.withColumn("length", (F.col("end_frame") - F.col("start_frame")).cast("int"))


def find_segments(differences: DataFrame, w: int = 5, enter: float = 0.5, leave: float = 0.3) -> DataFrame:
    """Smoothing, sign runs, validation, normalisation and thresholds of each game in one grouped stage.

    What the single operators do one after the other, with one exchange on the game.
    """

    def step(p: pd.DataFrame) -> pd.DataFrame:
        frames, y = p["frame_number"].tolist(), folds.smooth_in_place(p["value"].tolist(), w)
        n, bounds = len(y), [0]
        bounds += [i for i in range(1, n) if (y[i] >= 0) != (y[i - 1] >= 0)]
        runs = [(a, b - 1) for a, b in zip(bounds, [*bounds[1:], n], strict=True)]
        if runs and runs[-1][0] == n - 1:
            runs.pop()
        sign = [y[a] >= 0 for a, _ in runs]
        size = [max([0.0, *(abs(v) for v in y[a + (k > 0) : b + 1])]) for k, (a, b) in enumerate(runs)]
        out = []
        for no, ((a, b), positive, top, ok) in enumerate(zip(runs, sign, size, folds.valid_runs(sign, size), strict=True)):
            if ok:
                i, j = folds.crossing([abs(v) / top if top else 0.0 for v in y[a : b + 1]], enter, leave)
                out.append((no, frames[a + i], frames[a + j], "L" if positive else "R", frames[a + j] - frames[a + i]))
        return pd.DataFrame(out, columns=["run_id", "start_frame", "end_frame", "side", "length"])

    return fold(differences, ["game_id"], ["idx"], step, f"run_id int, {SEGMENT}")


def dead_band_markers(df: DataFrame, fraction: float = 0.0, offset: float = 0.4) -> DataFrame:
    def step(p: pd.DataFrame) -> pd.DataFrame:
        frames = p["frame_number"].tolist()
        return pd.DataFrame([(i, frames[i], s) for i, s in folds.dead_band_markers(p["value"].tolist(), fraction, offset)], columns=["idx", "frame_number", "status"])

    return fold(df, ["game_id"], ["idx"], step, "idx long, frame_number long, status string")


def zero_crossings(df: DataFrame, ahead: int = 7, least: float = 2.0) -> DataFrame:
    def step(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"frame_number": folds.zero_crossings(p["value"].tolist(), p["frame_number"].tolist(), ahead, least)}, dtype="int64").assign(status="TRANSITION")

    return fold(df, ["game_id"], ["idx"], step, "frame_number long, status string")


def pair_markers(markers: DataFrame) -> DataFrame:
    """Segments from each two markers in a row; a marker that is left over is dropped."""
    order = Window.partitionBy("game_id").orderBy("frame_number", "status")
    paired = markers.withColumns({"no": F.row_number().over(order), "end_frame": F.lead("frame_number").over(order)}).where("no % 2 = 1 AND end_frame IS NOT NULL")
    return paired.select("game_id", F.col("frame_number").alias("start_frame"), "end_frame", F.when(F.col("status") == "LEFT_START", "L").otherwise("R").alias("side"), (F.col("end_frame") - F.col("frame_number")).cast("int").alias("length"))


def gaps(segments: DataFrame) -> DataFrame:
    """What lies between a segment and the next one."""
    order = Window.partitionBy("game_id").orderBy("start_frame")
    return segments.withColumn("next", F.lead("start_frame").over(order)).where("next IS NOT NULL").select("game_id", (F.col("end_frame") + 1).alias("start_frame"), (F.col("next") - 1).alias("end_frame"))


def run_quality(signals: DataFrame, runs: DataFrame) -> DataFrame:
    """Six ways to tell how good a run is, from its match counts."""
    r = runs.select("game_id", "run_id", "start_idx", "end_idx")
    s = within(signals, r, "idx", "start_idx", "end_idx")
    v = (F.col("l_matches") - F.col("r_matches")).cast("double")
    share = F.abs(F.coalesce(F.try_divide(v, (F.col("l_matches") + F.col("r_matches")).cast("double")), F.lit(0.0))) * 100
    order = Window.partitionBy("game_id", "run_id").orderBy("idx")
    s = s.withColumns({"v": v, "share": share}).withColumns({"g": F.abs(F.col("v") - F.lag("v").over(order)), "gs": F.abs(F.col("share") - F.lag("share").over(order))})
    return s.groupBy("game_id", "run_id").agg(
        F.median("share").alias("median_share"), F.median(F.abs("v")).alias("median_value"), F.sum(F.abs("v")).alias("sum_value"), F.max(F.abs("v")).alias("max_value"),
        F.max("g").alias("max_gradient"), F.avg("g").alias("avg_gradient"), F.max("gs").alias("max_share_gradient"), F.avg("share").alias("avg_share"), F.max("share").alias("max_share"),
        F.try_divide(F.max(F.abs("v")) - F.min(F.abs("v")), F.max(F.abs("v")) + F.min(F.abs("v"))).alias("spread"),
    )


def top_mean(df: DataFrame, share: float = 0.9) -> DataFrame:
    """The mean of the magnitudes that reach ``share`` of a game's largest one."""
    size = F.abs(F.col("value"))
    top = F.max(size).over(Window.partitionBy("game_id"))
    return df.withColumns({"size": size, "top": top}).where(F.col("size") >= share * F.col("top")).groupBy("game_id").agg(F.avg("size").alias("top_mean"))
