"""Scores of what was found against what is true."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import folds


def with_rates(counts: DataFrame) -> DataFrame:
    """tp, fp and fn with precision and recall; null where nothing was found or true."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn)})


def ball_entry_scores(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Counts by segment are matched: what both have is right, what one has more is false or missed."""
    g = truth.groupBy("segment_id").agg(F.count("*").alias("g"))
    d = detected.where("frame >= 0").groupBy("segment_id").agg(F.count("*").alias("d"))
    both = g.join(d, "segment_id", "full").select(F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("d", F.lit(0)).alias("d"))
    return with_rates(both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("tp", F.least("g", "d")), ("fp", F.greatest(F.col("d") - F.col("g"), F.lit(0))), ("fn", F.greatest(F.col("g") - F.col("d"), F.lit(0)))))))


def _together(truth: DataFrame, found: DataFrame, step: Callable[[pd.DataFrame, pd.DataFrame], tuple], schema: str) -> DataFrame:
    """Both tables' rows of each game in one fold."""

    def run(key, t: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *step(t, f))])

    return truth.groupBy("game_id").cogroup(found.groupBy("game_id")).applyInPandas(run, f"game_id {truth.schema['game_id'].dataType.simpleString()}, {schema}")


def transition_scores(truth: DataFrame, found: DataFrame, tolerance: int = 105) -> DataFrame:
    return with_rates(_together(truth, found, lambda t, f: folds.match_once(sorted(f["frame_number"]), sorted(t["frame_number"]), tolerance), "tp int, fp int, fn int"))


def segment_scores(truth: DataFrame, segments: DataFrame) -> DataFrame:
    return with_rates(_together(truth, segments, lambda t, f: folds.match_segments(f.sort_values("start_frame")["end_frame"].tolist(), sorted(t["frame_number"])), "tp int, fp int, fn int"))


def segment_scores_between(truth: DataFrame, segments: DataFrame) -> DataFrame:
    def step(t, f):
        f = f.sort_values("start_frame")
        return folds.match_between(f["start_frame"].tolist(), f["end_frame"].tolist(), sorted(t["frame_number"]))

    return with_rates(_together(truth, segments, step, "tp int, fp int, fn int"))


def agreement(truth: DataFrame, segments: DataFrame) -> DataFrame:
    def rows(p):
        return list(p.sort_values("start_frame")[["start_frame", "end_frame", "side"]].itertuples(index=False, name=None))

    return _together(truth, segments, lambda t, f: folds.agreement(rows(t), rows(f)), "percent double, extra int, missed int")


def overlaps(truth: DataFrame, segments: DataFrame, stretch: int = 1024) -> DataFrame:
    """The set form: each found segment with what true ones of its side cover of it."""
    t = truth.select("game_id", "side", F.col("start_frame").alias("true_start"), F.col("end_frame").alias("true_end"))
    # Two stretches of frames meet where the one or the other starts: by game, side and stretch, each meeting once.
    of = lambda c: F.floor(F.col(c) / stretch)
    dealt = lambda df, a, b: df.withColumn("stretch", F.explode(F.sequence(of(a), of(b))))
    met = dealt(segments, "start_frame", "end_frame").join(dealt(t, "true_start", "true_end"), ["game_id", "side", "stretch"])
    met = met.where((F.col("start_frame") <= F.col("true_end")) & (F.col("true_start") <= F.col("end_frame")) & (F.col("stretch") == F.floor(F.greatest("start_frame", "true_start") / stretch)))
    covered = F.least("end_frame", "true_end") - F.greatest("start_frame", "true_start")
    return met.groupBy("game_id", "start_frame", "end_frame", "side").agg(F.sum(covered).alias("covered"), F.count("*").alias("met")).withColumn("share", F.try_divide(F.col("covered").cast("double"), (F.col("end_frame") - F.col("start_frame")).cast("double")))


def throughput(start: int, end: int, interval: int, seconds: float) -> dict[str, float]:
    """Processed frames and mean seconds of a frame, by the formula of the performance report."""
    frames = (end - start) // interval
    return {"frames": frames, "seconds": seconds, "seconds_a_frame": seconds / frames if frames else 0.0}
