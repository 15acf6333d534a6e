"""Text files of frames and segments: blank-separated, without header, read by position; and what writes them.

Every reader takes files or folders, drops blank lines and adds ``game_id``: the one given, else the one of the
folder that a file lies in (game_id=7), else the number in a file's name (Game#7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def _read(spark: SparkSession, path, schema: str) -> DataFrame:
    first = schema.split()[0]
    return spark.read.schema(schema).option("sep", " ").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path).where(F.col(first).isNotNull())


def _game(df: DataFrame, game_id: int | Column | None) -> DataFrame:
    if game_id is None:
        game_id = F.col("game_id") if "game_id" in df.columns else F.regexp_extract(F.input_file_name(), r"Game(?:#|%23)(\d+)", 1).try_cast("int")
    return df.select((F.lit(game_id) if isinstance(game_id, int) else game_id).alias("game_id"), *(c for c in df.columns if c != "game_id"))


def three_signals(spark: SparkSession, path, game_id=None) -> DataFrame:
    return _game(_read(spark, path, "frame_number BIGINT, l_matches INT, r_matches INT, m_matches INT"), game_id)


def differences(spark: SparkSession, path, game_id=None) -> DataFrame:
    return _game(_read(spark, path, "frame_number BIGINT, value DOUBLE"), game_id)


def markers(spark: SparkSession, path, game_id=None) -> DataFrame:
    """Ordinals become names."""
    df = _game(_read(spark, path, "frame_number BIGINT, ordinal INT"), game_id)
    return df.withColumn("status", F.get(F.lit(list(S.STATUSES)), F.col("ordinal"))).drop("ordinal")


def segments(spark: SparkSession, path, game_id=None) -> DataFrame:
    """Any letter but L is right."""
    df = _game(_read(spark, path, "start_frame BIGINT, end_frame BIGINT, letter STRING"), game_id)
    return df.select("game_id", "start_frame", "end_frame", F.when(F.col("letter") == "L", "L").otherwise("R").alias("side"), (F.col("end_frame") - F.col("start_frame")).cast("int").alias("length"))


def ball_entries(spark: SparkSession, path, game_id=None) -> DataFrame:
    """Frame -1: no shot; -2: the tracker did not start."""
    return _game(_read(spark, path, "segment_id INT, frame BIGINT"), game_id)


def entry_summary(entries: DataFrame) -> DataFrame:
    """Shots, segments without one, failed starts and the last segment."""
    n = lambda c: F.count(F.when(c, 1))
    return entries.agg(n(F.col("frame") >= 0).alias("shots"), n(F.col("frame") == -1).alias("no_shot"), n(F.col("frame") == -2).alias("failed"), F.max("segment_id").alias("last_segment"))


def boxes(spark: SparkSession, path, game_id=None, scale: float = 1.0) -> DataFrame:
    df = _game(_read(spark, path, "frame_number BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"), game_id)
    return df.select("game_id", "frame_number", S.box(*(F.col(c) * scale for c in "xywh")).alias("box"))


def active_cells(spark: SparkSession, path) -> DataFrame:
    """One file for each segment, whose number is the last one in the file's name."""
    df = _read(spark, path, "frame BIGINT, amplitude DOUBLE, s_grad DOUBLE")
    own = F.col("segment_id").cast("int") if "segment_id" in df.columns else F.regexp_extract(F.input_file_name(), r"(\d+)\D*$", 1).try_cast("int")
    return df.select(own.alias("segment_id"), "frame", "amplitude", "s_grad")


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines of one small list file with their numbers from 1."""
    df = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    return df.where(F.trim("line") != "").select((F.row_number().over(Window.orderBy("at"))).alias("line_no"), "line")


def video_names(spark: SparkSession, path) -> DataFrame:
    """(video_id, path) by line number, from 1."""
    return _lines(spark, path).select(F.col("line_no").alias("video_id"), F.trim("line").alias("path"))


def reference_boxes(spark: SparkSession, path) -> DataFrame:
    """Two lines: the left box, then the right one."""
    part = F.split(F.trim("line"), r"\s+")
    return _lines(spark, path).select(F.when(F.col("line_no") == 1, "L").otherwise("R").alias("side"), S.box(*(part[i].cast("double") for i in range(4))).alias("box"))


def line_count(spark: SparkSession, path) -> int:
    return spark.read.text(path).count()


def images(spark: SparkSession, path) -> DataFrame:
    """Images of a folder in the order of their names, decoded by the JVM."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("origin"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def image_sequence(spark: SparkSession, path) -> DataFrame:
    """Images named by their number."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)
    return df.withColumn("index", F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("long"))


def strided_frames(spark: SparkSession, start: int = 1, end: int = 10_000, interval: int = 15) -> DataFrame:
    """Frames from start by interval, end excluded; ``idx`` counts them."""
    return spark.range(start, end, interval).select(F.floor((F.col("id") - start) / interval).cast("long").alias("idx"), F.col("id").alias("frame_number"))


def frame_at(idx: Column, start: int = 1, interval: int = 15) -> Column:
    return (idx * interval + start).cast("long")


def histograms(spark: SparkSession, path) -> DataFrame:
    """(candidate, histogram) from files of blank-separated numbers, one candidate a line: its name first."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(part[0].alias("candidate"), F.transform(F.slice(part, 2, F.size(part)), lambda v: v.cast("double")).alias("histogram"))


# --- sinks ------------------------------------------------------------------------------------------------------
def write_lines(df: DataFrame, path: str, columns: list[str], by: list[str] | None = None, mode: str = "error") -> None:
    """Blank-separated columns as text, in folders for each value of ``by``. ``mode="overwrite"`` resets the folder, ``"append"`` adds."""
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value")
    lines = df.select(*(by or []), line)
    writer = (lines.repartition(*by) if by else lines).write.mode(mode)  # one file for each value of ``by``
    (writer.partitionBy(*by) if by else writer).text(path)


def write_signals(df: DataFrame, path: str, middle: bool = True, mode: str = "error") -> None:
    write_lines(df, path, ["frame_number", "l_matches", "r_matches", *(["m_matches"] if middle else [])], ["game_id"], mode)


def write_differences(df: DataFrame, path: str, mode: str = "error") -> None:
    write_lines(df, path, ["frame_number", "value"], ["game_id"], mode)


def write_segments(df: DataFrame, path: str, mode: str = "error") -> None:
    write_lines(df, path, ["start_frame", "end_frame", "side"], ["game_id"], mode)


def write_active_cells(df: DataFrame, path: str, mode: str = "error") -> None:
    write_lines(df, path, [c for c in ("frame", "amplitude", "s_grad") if c in df.columns], ["segment_id"], mode)


def write_ball_entries(df: DataFrame, path: str) -> None:
    write_lines(df, path, ["segment_id", "frame"], ["game_id"] if "game_id" in df.columns else None, "append")


def write_boxes(df: DataFrame, path: str, scale: float = 1.0, mode: str = "error") -> None:
    flat = df.select("game_id", "frame_number", *((F.col(f"box.{c}") / scale).cast("int").alias(c) for c in "xywh"))
    write_lines(flat, path, ["frame_number", "x", "y", "w", "h"], ["game_id"], mode)


def write_edges(df: DataFrame, path: str, mode: str = "error") -> None:
    write_lines(df, path, ["src", "dst"], None, mode)


def write_markers(df: DataFrame, path: str, negated: bool = False, mode: str = "error") -> None:
    """Frames of markers; the list of zero crossings holds them negated."""
    write_lines(df.withColumn("out", -F.col("frame_number") if negated else F.col("frame_number")), path, ["out"], ["game_id"], mode)


def write_vectors(df: DataFrame, path: str, mode: str = "error") -> None:
    """Feature vectors, one frame a line."""
    line = F.array_join(F.transform("vector", lambda v: v.cast("string")), " ")
    write_lines(df.withColumn("line", line), path, ["line"], ["segment_id"], mode)


def write_frame_index(df: DataFrame, path: str, mode: str = "error") -> None:
    """Places and the frames they stand for."""
    df.select("idx", "frame_number").write.mode(mode).parquet(path)


def write_crops(df: DataFrame, path: str, mode: str = "error") -> None:
    """Cropped images as rows: segment, number, bytes and the name they go by."""
    df.withColumn("name", F.format_string("S%d_%04d.jpg", "segment_id", "frame")).write.mode(mode).partitionBy("segment_id").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Score rows, added to what the folder has."""
    metrics.write.mode("append").json(path)


def file_name(game_id: Column, interval: int, scale: float) -> Column:
    return F.format_string(f"Game#%d_Auto_i{interval}_s{scale:g}.txt", game_id)
