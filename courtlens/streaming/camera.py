"""The side signal and the camera's rests as a stream of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalar as S


def differences(signals: DataFrame) -> DataFrame:
    """A row-wise step, the same on streams."""
    return signals.withColumn("value", S.side_difference(F.col("l_matches"), F.col("r_matches")))


def windowed_means(signals: DataFrame, length: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Mean difference of each game by stretches of event time (column ``ts``); late rows count up to ``delay``."""
    return differences(signals).withWatermark("ts", delay).groupBy("game_id", F.window("ts", length)).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def camera_candidates(motions: DataFrame, most_still: int = 30) -> DataFrame:
    """(game_id, start_idx, end_idx, side) as soon as a rest between two opposite moves is complete.

    The state of a game is five numbers: where the camera moves, where its rest began, resting and opposite samples
    so far, and the next place. Samples of a game arrive in order (idx).
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        moving, start, still, against, at = state.get if state.exists else ("", -1, 0, 0, 0)
        out = []
        for p in frames:
            for m in p.sort_values("idx")["motion"]:
                if not moving:
                    moving = "" if m == "STILL" else m
                elif m == "STILL":
                    if start < 0:
                        start = at
                    else:
                        still += 1
                elif m == moving:
                    start, against = -1, 0
                elif start >= 0:
                    against += 1
                    if against > 1 and still > 1:
                        moving = m
                        if still <= most_still:
                            out.append((key[0], start, at - against, "RIGHT" if m == "MOVINGLEFT" else "LEFT"))
                        start, still, against = -1, 0, 0
                at += 1
        state.update((moving, start, still, against, at))
        yield pd.DataFrame(out, columns=["game_id", "start_idx", "end_idx", "side"])

    game = motions.schema["game_id"].dataType.simpleString()
    return motions.groupBy("game_id").applyInPandasWithState(step, f"game_id {game}, start_idx long, end_idx long, side string", "moving string, start long, still long, against long, at long", "append", GroupStateTimeout.NoTimeout)
