"""Places within ranges, joined by game and by stretches of places, so that no game meets itself whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(places: DataFrame, ranges: DataFrame, at: str, start: str, end: str, key: str = "game_id", stretch: int = 64) -> DataFrame:
    """Each place with each range of its game that holds it, ends included."""
    of = lambda c: F.floor(F.col(c) / stretch)
    dealt = ranges.withColumn("_stretch", F.explode(F.sequence(of(start), of(end))))
    return places.withColumn("_stretch", of(at)).join(dealt, [key, "_stretch"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_stretch")
