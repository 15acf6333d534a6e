"""Video-like inputs derived from the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.signal import signal_difference


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as samples of a game: sides change every eight samples, with some noise in the counts."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    e = e.withColumn("idx", idx).withColumn("phase", (F.floor(F.col("idx") / 8) + F.col("user_id")) % 2)
    quarter = (F.floor(F.col("idx") / 4) + F.col("user_id")) % 4
    return e.select(
        F.col("user_id").alias("game_id"), "idx", (F.col("idx") * 15 + 1).alias("frame_number"), "phase", "event_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("amplitude"),
        (F.when(F.col("phase") == 0, 40).otherwise(5) + F.col("event_id") * 37 % 11).cast("int").alias("l_matches"),
        (F.when(F.col("phase") == 1, 40).otherwise(5) + F.col("event_id") * 53 % 13).cast("int").alias("r_matches"),
        (F.col("event_id") % 7).cast("int").alias("m_matches"),
        F.when(quarter == 0, "MOVINGRIGHT").when(quarter == 2, "MOVINGLEFT").otherwise("STILL").alias("motion"),
    )


def signals(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).select("game_id", "idx", "frame_number", "l_matches", "r_matches", "m_matches")


def differences(spark, sf_dir) -> DataFrame:
    return signal_difference(signals(spark, sf_dir))


def motions(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).select("game_id", "idx", "frame_number", "motion")


def truth_markers(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).where("idx % 8 = 0 AND idx > 0").select("game_id", (F.col("frame_number") + F.col("event_id") % 40).alias("frame_number"))


def found_segments(spark, sf_dir) -> DataFrame:
    s = samples(spark, sf_dir).where("idx % 6 = 0")
    return s.select("game_id", F.col("frame_number").alias("start_frame"), (F.col("frame_number") + 45 + F.col("event_id") % 30).alias("end_frame"), F.when(F.col("phase") == 0, "L").otherwise("R").alias("side"), (45 + F.col("event_id") % 30).cast("int").alias("length"))


def true_segments(spark, sf_dir) -> DataFrame:
    s = samples(spark, sf_dir).where("idx % 8 = 0")
    return s.select("game_id", F.col("frame_number").alias("start_frame"), (F.col("frame_number") + 105).alias("end_frame"), F.when(F.col("phase") == 0, "L").otherwise("R").alias("side"))


def cells_of(spark, sf_dir) -> DataFrame:
    """Mean magnitudes of nine cells for each sample: (segment_id, frame, cell_idx, mean)."""
    s = samples(spark, sf_dir).select(F.col("game_id").alias("segment_id"), F.col("idx").alias("frame"), "event_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("cell_idx"))
    return s.select("segment_id", "frame", "cell_idx", (((F.col("event_id") * 31 + F.col("cell_idx") * F.col("cell_idx") * 17) % 97) / 10.0).alias("mean"))


def features(spark, sf_dir) -> DataFrame:
    """Embeddings as descriptors of ten images."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("image_id"), v.alias("feature_id"), (v % 320).cast("double").alias("x"), (v * 7 % 180).cast("double").alias("y"), F.col("embedding").alias("descr"))


def boxes(spark, sf_dir) -> DataFrame:
    """A box for each line of an order: (game_id, frame_number, box)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    frame = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return li.select(F.col("l_orderkey").alias("game_id"), frame.cast("long").alias("frame_number"), F.struct((F.col("l_partkey") % 100).cast("int").alias("x"), (F.col("l_suppkey") % 80).cast("int").alias("y"), (10 + F.col("l_partkey") % 40).cast("int").alias("w"), (10 + F.col("l_suppkey") % 30).cast("int").alias("h")).alias("box"))


SAMPLES = """s0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
s1 AS (SELECT *, (idx // 8 + user_id) % 2 AS phase, (idx // 4 + user_id) % 4 AS quarter FROM s0),
samples AS (SELECT user_id AS game_id, idx, idx * 15 + 1 AS frame_number, phase, event_id, event_type, coalesce(value, 0.0) AS amplitude,
  CAST((CASE WHEN phase = 0 THEN 40 ELSE 5 END) + event_id * 37 % 11 AS INT) AS l_matches,
  CAST((CASE WHEN phase = 1 THEN 40 ELSE 5 END) + event_id * 53 % 13 AS INT) AS r_matches,
  CAST(event_id % 7 AS INT) AS m_matches,
  CASE quarter WHEN 0 THEN 'MOVINGRIGHT' WHEN 2 THEN 'MOVINGLEFT' ELSE 'STILL' END AS motion FROM s1),
diffs AS (SELECT game_id, idx, frame_number, CAST(l_matches - r_matches AS DOUBLE) AS value FROM samples)"""
TRUTH = """truth AS (SELECT game_id, frame_number + event_id % 40 AS frame_number FROM samples WHERE idx % 8 = 0 AND idx > 0)"""
FOUND = """found AS (SELECT game_id, frame_number AS start_frame, frame_number + 45 + event_id % 30 AS end_frame, CASE WHEN phase = 0 THEN 'L' ELSE 'R' END AS side FROM samples WHERE idx % 6 = 0)"""
TRUE_SEGMENTS = """trues AS (SELECT game_id, frame_number AS start_frame, frame_number + 105 AS end_frame, CASE WHEN phase = 0 THEN 'L' ELSE 'R' END AS side FROM samples WHERE idx % 8 = 0)"""
CELLS = """cells AS (SELECT game_id AS segment_id, idx AS frame, c AS cell_idx, ((event_id * 31 + c * c * 17) % 97) / 10.0::DOUBLE AS mean FROM samples, (SELECT unnest(range(9))::INT AS c))"""
FEATURES = """features AS (SELECT CAST(label AS BIGINT) AS image_id, vec_id AS feature_id, CAST(vec_id % 320 AS DOUBLE) AS x, CAST(vec_id * 7 % 180 AS DOUBLE) AS y, embedding AS descr FROM embeddings)"""
BOXES = """boxes AS (SELECT l_orderkey AS game_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS frame_number, CAST(l_partkey % 100 AS INT) AS x, CAST(l_suppkey % 80 AS INT) AS y, CAST(10 + l_partkey % 40 AS INT) AS w, CAST(10 + l_suppkey % 30 AS INT) AS h FROM lineitem)"""


def smoothing(w: int = 5, source: str = "diffs", key: str = "game_id", name: str = "smooth", value: str = "value") -> str:
    """CTEs of the in-place smoothing, as a recursion that carries what has been smoothed."""
    return f"""{name}_x AS (SELECT {key}, list({value} ORDER BY idx) AS x, count(*) AS n FROM {source} GROUP BY {key}),
{name}_r AS (SELECT {key}, 0 AS i, CAST([] AS DOUBLE[]) AS acc FROM {name}_x
  UNION ALL SELECT r.{key}, r.i + 1, list_append(r.acc, list_sum(list_transform(range(r.i + 1 - {w}, r.i + 2 + {w}), lambda k:
    CASE WHEN k < 1 THEN (CASE WHEN r.i = 0 THEN a.x[1] ELSE r.acc[1] END) WHEN k <= r.i THEN r.acc[k] ELSE a.x[least(k, a.n)] END)) / {2 * w + 1})
  FROM {name}_r r JOIN {name}_x a USING ({key}) WHERE r.i < a.n),
{name} AS (SELECT {key}, unnest(range(a.n)) AS idx, unnest(r.acc) AS value FROM {name}_r r JOIN {name}_x a USING ({key}) WHERE r.i = a.n)"""
