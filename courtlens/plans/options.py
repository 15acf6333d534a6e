"""Options of the three programs, and a command line for them: python -m courtlens.plans.options PROGRAM ..."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ballentry, evaluate, match, segments, signal
from ..sources import text


@dataclass
class SignalOptions:
    """From descriptors to match counts: ``references`` and ``features`` are tables of descriptors."""

    references: str
    features: str
    out: str
    left: int = 0
    right: int = 1
    middle: int = 2
    ratio: float = match.RATIO
    start: int = 1
    end: int = 10_000
    interval: int = 15
    scale: float = 3.0


@dataclass
class SegmentOptions:
    """From match counts to plays."""

    signals: str
    out: str
    smoothing: int = 5
    enter: float = 0.5
    leave: float = 0.3


@dataclass
class EntryOptions:
    """From active cells to ball entries."""

    cells: str
    out: str
    smoothing: int = 2
    size_factor: float = 1.5
    apart: float = 0.4


@dataclass
class EvaluateOptions:
    """Scores of ball entries or segments: ``kind`` is entries, segments or agreement."""

    truth: str
    found: str
    out: str
    kind: str = "segments"


def extract_signals(spark: SparkSession, o: SignalOptions) -> DataFrame:
    features = spark.read.parquet(o.features).where((F.col("image_id") >= o.start) & (F.col("image_id") < o.end) & ((F.col("image_id") - o.start) % o.interval == 0))
    counts = match.match_counts(match.matches(spark.read.parquet(o.references), features, o.ratio))
    return match.signals(counts, o.left, o.right, o.middle).withColumnRenamed("image_id", "frame_number")


def find_segments(spark: SparkSession, o: SegmentOptions) -> DataFrame:
    from pyspark.sql import Window

    signals = text.three_signals(spark, o.signals)
    order = Window.partitionBy("game_id").orderBy("frame_number")
    signals = signals.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return segments.find_segments(signal.signal_difference(signals), o.smoothing, o.enter, o.leave)


def find_entries(spark: SparkSession, o: EntryOptions) -> DataFrame:
    series = ballentry.amplitude_features(text.active_cells(spark, o.cells).select("segment_id", "frame", "amplitude"), o.smoothing)
    merged = ballentry.merge_windows(ballentry.split_windows(ballentry.windows(series), o.size_factor, o.apart))
    return ballentry.with_missing(ballentry.strongest_moment(merged, series), series)


def score(spark: SparkSession, o: EvaluateOptions) -> DataFrame:
    if o.kind == "entries":
        return evaluate.ball_entry_scores(text.ball_entries(spark, o.truth, 0), text.ball_entries(spark, o.found, 0))
    if o.kind == "agreement":
        return evaluate.agreement(text.segments(spark, o.truth), text.segments(spark, o.found))
    return evaluate.segment_scores_between(text.markers(spark, o.truth), text.segments(spark, o.found))


PROGRAMS = {"signals": (SignalOptions, extract_signals), "segments": (SegmentOptions, find_segments), "entries": (EntryOptions, find_entries), "evaluate": (EvaluateOptions, score)}


def parse(args: list[str] | None = None):
    """(program, options) of a command line."""
    parser = argparse.ArgumentParser(prog="courtlens")
    programs = parser.add_subparsers(dest="program", required=True)
    for name, (kind, _) in PROGRAMS.items():
        own = programs.add_parser(name, help=kind.__doc__)
        for f in fields(kind):
            needed = f.default is f.default_factory
            own.add_argument(f"--{f.name.replace('_', '-')}", type={"int": int, "float": float}.get(str(f.type), str), required=needed, default=None if needed else f.default)
    found = vars(parser.parse_args(args))
    program = found.pop("program")
    return program, PROGRAMS[program][0](**found)


def main() -> None:
    program, options = parse()
    spark = SparkSession.builder.appName(f"courtlens {program}").getOrCreate()
    began = time.perf_counter()
    PROGRAMS[program][1](spark, options).write.mode("overwrite").parquet(options.out)
    seconds = time.perf_counter() - began
    if isinstance(options, SignalOptions):
        print(evaluate.throughput(options.start, options.end, options.interval, seconds))
    else:
        print({"seconds": seconds})


if __name__ == "__main__":
    main()
