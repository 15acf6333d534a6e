"""Every registered query of the engine, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ballentry, boxes, camera, cluster, evaluate, grid, histograms, match, segments, signal
from ..sources import text
from ..sources.store import scratch
from . import fixtures as X
from . import oracles as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, for comparison."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


W = f"WITH {X.SAMPLES}"
R = f"WITH RECURSIVE {X.SAMPLES}"


# --- 2.1 and 2.2: sources and sinks, as round trips through files -------------------------------------------------
@query("s1_k1_three_signals", f"{W} SELECT game_id, frame_number, l_matches, r_matches, m_matches FROM samples")
def _(spark, d):
    path = scratch(spark, "signals")
    text.write_signals(X.signals(spark, d), path)
    return text.three_signals(spark, path, F.col("game_id").cast("long"))


@query("s2_k1_differences", f"{W} SELECT game_id, least(0, min(CAST(value AS INT))) AS low, greatest(0, max(CAST(value AS INT))) AS high, count(*) AS n FROM diffs GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "differences")
    text.write_differences(X.differences(spark, d), path)
    df = text.differences(spark, path, F.col("game_id").cast("long"))
    return signal.value_bounds(df).join(df.groupBy("game_id").agg(F.count("*").alias("n")), "game_id")


@query("s3_markers", f"{W} SELECT game_id, frame_number, ['START','STILL','LEFT2RIGHT','RIGHT2LEFT','TIMEOUT','TRANSITION','LEFT_START','LEFT_END','RIGHT_START','RIGHT_END'][event_id % 10 + 1] AS status FROM samples WHERE idx % 3 = 0")
def _(spark, d):
    path = scratch(spark, "markers")
    text.write_lines(X.samples(spark, d).where("idx % 3 = 0").withColumn("s", F.col("event_id") % 10), path, ["frame_number", "s"], ["game_id"])
    return text.markers(spark, path, F.col("game_id").cast("long"))


@query("s4_k2_segments", f"{W}, {X.FOUND} SELECT game_id, start_frame, end_frame, side, CAST(end_frame - start_frame AS INT) AS length FROM found")
def _(spark, d):
    path = scratch(spark, "segments")
    text.write_segments(X.found_segments(spark, d), path)
    return text.segments(spark, path, F.col("game_id").cast("long"))


@query("s5_video_names", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS video_id, n_name || '.mpg' AS path FROM nation")
def _(spark, d):
    path = scratch(spark, "videos")
    X.table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.concat("n_name", F.lit(".mpg"))).write.text(path)
    return text.video_names(spark, path)


@query("s6_k4_entry_summary", f"{W} SELECT count(*) FILTER (e >= 0) AS shots, count(*) FILTER (e = -1) AS no_shot, count(*) FILTER (e = -2) AS failed, CAST(max(game_id) AS INT) AS last_segment FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN -1 WHEN 1 THEN -2 ELSE frame_number END AS e FROM samples)")
def _(spark, d):
    path = scratch(spark, "entries")
    e = X.samples(spark, d).select(F.col("game_id").alias("segment_id"), F.when(F.col("event_id") % 7 == 0, -1).when(F.col("event_id") % 7 == 1, -2).otherwise(F.col("frame_number")).alias("frame"))
    text.write_ball_entries(e, path)
    return text.entry_summary(text.ball_entries(spark, path, 1))


@query("s7_k9_boxes", f"WITH {X.BOXES} SELECT CAST(game_id % 100 AS INT) AS game_id, game_id * 10 + frame_number AS frame_number, x, y, w, h FROM boxes")
def _(spark, d):
    path = scratch(spark, "boxes")
    # Text files in a folder for each game: all boxes, in a hundred games.
    text.write_boxes(X.boxes(spark, d).withColumns({"frame_number": F.col("game_id") * 10 + F.col("frame_number"), "game_id": F.col("game_id") % 100}), path)
    return text.boxes(spark, path, F.col("game_id").cast("int")).select("game_id", "frame_number", "box.*")


@query("s8_reference_boxes", "SELECT * FROM (VALUES ('L', 10, 20, 30, 40), ('R', 200, 21, 31, 41)) t(side, x, y, w, h)")
def _(spark, d):
    path = scratch(spark, "reference")
    spark.createDataFrame([("10 20 30 40\n200 21 31 41\n",)], "value string").coalesce(1).write.text(path)
    return text.reference_boxes(spark, path).select("side", "box.*")


@query("s9_line_count", "SELECT count(*) AS n FROM nation")
def _(spark, d):
    path = scratch(spark, "lines")
    X.table(spark, d, "nation").select("n_name").write.text(path)
    return spark.createDataFrame([(text.line_count(spark, path),)], "n long")


@query("s11_strided_frames", "SELECT (f - 1) // 15 AS idx, f AS frame_number FROM (SELECT unnest(range(1, 10000, 15)) AS f)")
def _(spark, d):
    return text.strided_frames(spark)


@query("k3_active_cells", f"{W} SELECT CAST(game_id AS INT) AS segment_id, idx AS frame, round(amplitude, 6) AS amplitude, CAST(NULL AS DOUBLE) AS s_grad FROM samples")
def _(spark, d):
    path = scratch(spark, "cells")
    text.write_active_cells(X.samples(spark, d).select(F.col("game_id").alias("segment_id"), F.col("idx").alias("frame"), "amplitude"), path)
    return rounded(text.active_cells(spark, path))


@query("k5_report", f"{W} SELECT game_id, count(*) AS n, max(frame_number) AS last_frame FROM samples GROUP BY 1 UNION ALL SELECT -1, count(*), max(frame_number) FROM samples")
def _(spark, d):
    path, s = scratch(spark, "report"), X.samples(spark, d)
    measures = F.count("*").alias("n"), F.max("frame_number").alias("last_frame")
    text.write_report(s.groupBy("game_id").agg(*measures), path)
    text.write_report(s.agg(*measures).withColumn("game_id", F.lit(-1).cast("long")), path)  # added to what is there
    return spark.read.schema("game_id long, n long, last_frame long").json(path)


@query("k6_a21_throughput", "SELECT 666 AS frames, 33.3::DOUBLE AS seconds, round(33.3 / 666, 6)::DOUBLE AS seconds_a_frame")
def _(spark, d):
    return rounded(spark.createDataFrame([tuple(evaluate.throughput(1, 10_000, 15, 33.3).values())], "frames int, seconds double, seconds_a_frame double"))


@query("k7_vector_files", f"{W}, {X.CELLS}, m AS (SELECT segment_id, frame, avg(mean) AS av, max(mean) AS mx, list(mean) AS l FROM cells GROUP BY 1, 2) SELECT CAST(segment_id AS INT) AS segment_id, list_sort(list_transform(l, lambda v: round((v - av) / (mx - av), 6))) AS vector FROM m")
def _(spark, d):
    path = scratch(spark, "vectors")
    text.write_vectors(grid.cell_vectors(X.cells_of(spark, d)), path)
    vector = F.transform(F.split("value", " "), lambda v: F.round(v.cast("double"), 6)).alias("vector")
    return spark.read.text(path).select(F.col("segment_id").cast("int").alias("segment_id"), vector)


@query("k8_negated_crossings", O.ZERO_CROSSINGS.rsplit("\nSELECT", 1)[0] + " SELECT CAST(game_id AS INT) AS game_id, -frame_number AS frame_number FROM z")
def _(spark, d):
    path = scratch(spark, "crossings")
    text.write_markers(segments.zero_crossings(signal.smooth(X.differences(spark, d))), path, negated=True)
    return spark.read.text(path).select(F.col("game_id").cast("int").alias("game_id"), F.col("value").cast("long").alias("frame_number"))


@query("k10_crops", f"{W} SELECT CAST(game_id AS INT) AS segment_id, idx AS frame, 'S' || game_id || '_' || printf('%04d', idx) || '.jpg' AS name, CAST(length(CAST(event_id AS VARCHAR)) AS INT) AS bytes FROM samples")
def _(spark, d):
    path = scratch(spark, "crops")
    text.write_crops(X.samples(spark, d).select(F.col("game_id").alias("segment_id"), F.col("idx").alias("frame"), F.col("event_id").cast("string").cast("binary").alias("data")), path)
    return spark.read.parquet(path).select(F.col("segment_id").cast("int").alias("segment_id"), "frame", "name", F.length("data").alias("bytes"))


@query("k12_frame_index", "SELECT (f - 1) // 15 AS idx, f AS frame_number FROM (SELECT unnest(range(1, 10000, 15)) AS f)")
def _(spark, d):
    path = scratch(spark, "index")
    text.write_frame_index(text.strided_frames(spark), path)
    return spark.read.parquet(path)


@query("k13_reset_folder", f"{W} SELECT CAST(game_id AS INT) AS game_id, frame_number, l_matches, r_matches, CAST(0 AS INT) AS m_matches FROM samples WHERE phase = 1")
def _(spark, d):
    path, s = scratch(spark, "reset"), X.samples(spark, d)
    text.write_signals(s, path)
    text.write_signals(s.where("phase = 1"), path, middle=False, mode="overwrite")  # what was there goes
    return text.three_signals(spark, path, F.col("game_id").cast("int")).select("game_id", "frame_number", "l_matches", "r_matches", F.coalesce("m_matches", F.lit(0)).alias("m_matches"))


@query("s16_histograms", f"{W} SELECT 'c' || event_id AS candidate, [CAST(l_matches AS DOUBLE), CAST(r_matches AS DOUBLE), CAST(m_matches AS DOUBLE)] AS histogram FROM samples")
def _(spark, d):
    path = scratch(spark, "histograms")
    s = X.samples(spark, d).withColumn("candidate", F.concat(F.lit("c"), F.col("event_id").cast("string")))
    text.write_lines(s, path, ["candidate", "l_matches", "r_matches", "m_matches"])
    return text.histograms(spark, path)


# --- 2.3: scalar functions ----------------------------------------------------------------------------------------
@query("f1_side_difference", f"{W} SELECT * FROM diffs")
def _(spark, d):
    return X.differences(spark, d)


@query("f2_normalised_difference", f"{W} SELECT game_id, idx, round(CASE WHEN l_matches + m_matches = 0 THEN NULL ELSE (l_matches - m_matches) / CAST(l_matches + m_matches AS DOUBLE) * 100 END, 6) AS share FROM samples")
def _(spark, d):
    return X.signals(spark, d).select("game_id", "idx", r6(S.normalised_difference(F.col("l_matches"), F.col("m_matches")), "share"))


@query("f3_f4_f26_sides", f"{W} SELECT game_id, idx, value < 0 AS is_right, value >= 0 AS is_left, CASE WHEN value <= -20.0 THEN 'RIGHT' WHEN value >= 20.0 THEN 'LEFT' ELSE 'MID' END AS side, (value < 0 AND idx % 2 <> 1) OR (value >= 0 AND idx % 2 <> 0) AS changed FROM diffs")
def _(spark, d):
    v = F.col("value")
    return X.differences(spark, d).select("game_id", "idx", S.is_right(v).alias("is_right"), S.is_left(v).alias("is_left"), S.side_in_band(v, 0.0, 20.0).alias("side"), S.side_changed(v, F.col("idx") % 2).alias("changed"))


_BOUNDS = f"{W}, b AS (SELECT game_id, least(0, min(CAST(value AS INT))) AS low, greatest(0, max(CAST(value AS INT))) AS high FROM diffs GROUP BY 1), v AS (SELECT * FROM diffs JOIN b USING (game_id))"
for _mode, _expr in ((0, "(value - low) / (high - low)"), (1, "-1 + (value - low) * 2 / (high - low)"), (2, "CASE WHEN value <= 0 THEN -1 + (value - low) / (-low) ELSE value / high END"), (3, "value")):

    @query(f"f5_normalise_mode{_mode}", f"{_BOUNDS} SELECT game_id, idx, frame_number, round({_expr}, 6) AS value FROM v")
    def _(spark, d, _mode=_mode):
        df = X.differences(spark, d)
        return rounded(signal.normalise(df, signal.value_bounds(df), _mode))


@query("f6_normalise_clamped", f"{_BOUNDS} SELECT game_id, idx, frame_number, round(CASE WHEN value < 0 THEN (CASE WHEN value < low / 2.0 THEN -1 ELSE value / (-low / 2.0) END) ELSE (CASE WHEN value > high / 2.0 THEN 1 ELSE value / (high / 2.0) END) END, 6) AS value FROM v")
def _(spark, d):
    df = X.differences(spark, d)
    half = signal.value_bounds(df).select("game_id", (F.col("low") / 2).alias("low"), (F.col("high") / 2).alias("high"))
    return rounded(signal.normalise(df, half, 2, clamped=True))


@query("f8_transition_band", f"{_BOUNDS} SELECT game_id, round(-low / CAST(high - low AS DOUBLE), 6) AS fraction, 0.045::DOUBLE AS o FROM b")
def _(spark, d):
    f, o = S.transition_band(0, F.col("low").cast("double"), F.col("high").cast("double"))
    return signal.value_bounds(X.differences(spark, d)).select("game_id", r6(f, "fraction"), o.alias("o"))


@query("f9_f10_f11_f12_f28_flow", f"WITH {X.FEATURES} SELECT feature_id, round(sqrt(x*x+y*y), 6) AS r, round(atan2(y, x), 6) AS theta, round(atan2(y - 90, x - 160), 6) AS direction, round(sqrt((x-160)*(x-160)+(y-90)*(y-90)), 6) AS magnitude, CASE WHEN sqrt((x-160)*(x-160)+(y-90)*(y-90)) < 100 THEN 'STILL' WHEN abs(atan2(y - 90, x - 160)) < pi() / 2 THEN 'MOVINGRIGHT' ELSE 'MOVINGLEFT' END AS motion, round(atan2(y, x) * (180 / 3.14159::DOUBLE), 6) AS deg FROM features")
def _(spark, d):
    f = S.flow(F.lit(160.0), F.lit(90.0), F.col("x"), F.col("y"))
    p = S.polar(F.col("x"), F.col("y"))
    return X.features(spark, d).select("feature_id", r6(p["r"], "r"), r6(p["theta"], "theta"), r6(f["direction"], "direction"), r6(f["magnitude"], "magnitude"), S.camera_state(f["direction"], f["magnitude"]).alias("motion"), r6(S.degrees(p["theta"]), "deg"))


_PAIRS = f"WITH {X.BOXES}, p AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM boxes WINDOW o AS (PARTITION BY game_id ORDER BY frame_number)), q AS (SELECT *, greatest(0, least(x+w, px+pw) - greatest(x, px)) * greatest(0, least(y+h, py+ph) - greatest(y, py)) AS inter FROM p WHERE px IS NOT NULL)"


def _box_pairs(spark, d):
    from pyspark.sql import Window

    return X.boxes(spark, d).withColumn("before", F.lag("box").over(Window.partitionBy("game_id").orderBy("frame_number"))).where("before IS NOT NULL")


@query("f13_valid_box", f"{_PAIRS} SELECT game_id, frame_number, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 130 AND y + h <= 100 AND abs(w - pw) <= 0.75 * pw AND abs(h - ph) <= 0.75 * ph AS ok FROM q")
def _(spark, d):
    return _box_pairs(spark, d).select("game_id", "frame_number", S.valid_box(F.col("box"), F.col("before"), 130, 100).alias("ok"))


@query("f14_touching", f"{_PAIRS} SELECT game_id, frame_number, x <= px + pw AND px <= x + w AND y <= py + ph AND py <= y + h AS ok FROM q")
def _(spark, d):
    return _box_pairs(spark, d).select("game_id", "frame_number", S.touching(F.col("box"), F.col("before")).alias("ok"))


@query("f15_f16_overlap_in_hull", f"{_PAIRS} SELECT game_id, frame_number, round(inter / CAST((greatest(x+w, px+pw) - least(x, px)) * (greatest(y+h, py+ph) - least(y, py)) AS DOUBLE), 6) AS share, round(greatest(0, least(x+w, px+w) - greatest(x, px)) * greatest(0, least(y+h, py+ph) - greatest(y, py)) / CAST((greatest(x+w, px+w) - least(x, px)) * (greatest(y+h, py+ph) - least(y, py)) AS DOUBLE), 6) AS share_compat FROM q")
def _(spark, d):
    return _box_pairs(spark, d).select("game_id", "frame_number", r6(S.overlap_in_hull(F.col("box"), F.col("before")), "share"), r6(S.overlap_in_hull(F.col("box"), F.col("before"), True), "share_compat"))


@query("f17_box_properties", f"{_PAIRS} SELECT game_id, frame_number, round(inter / CAST(w*h + pw*ph - inter AS DOUBLE), 6) AS iou, round(sqrt(((x + w//2) - (px + pw//2))**2 + ((y + h//2) - (py + ph//2))**2), 6) AS distance FROM q")
def _(spark, d):
    p = S.box_properties(F.col("box"), F.col("before"))
    return _box_pairs(spark, d).select("game_id", "frame_number", r6(p["iou"], "iou"), r6(p["distance"], "distance"))


@query("f18_steady", f"WITH {X.BOXES}, p AS (SELECT *, x + w / 2.0 AS cx, y + h / 2.0 AS cy FROM boxes) SELECT game_id, frame_number, coalesce((cx - lag(cx) OVER o) ** 2 + (cy - lag(cy) OVER o) ** 2 < 400, true) AS steady FROM p WINDOW o AS (PARTITION BY game_id ORDER BY frame_number)")
def _(spark, d):
    return boxes.steady(X.boxes(spark, d), 400.0).select("game_id", "frame_number", "steady")


@query("f19_f20_adjacent", f"{_PAIRS} SELECT game_id, frame_number, abs(x - px) <= 1 AND abs(y - py) <= 1 AS adjacent, abs(x - px) + abs(y - py) <= 3 AS near, x >= 0 AND y >= 0 AND x + w < 90 AND y + h < 70 AS inside FROM q")
def _(spark, d):
    a, b = F.col("box"), F.col("before")
    return _box_pairs(spark, d).select("game_id", "frame_number", S.adjacent(a["x"], a["y"], b["x"], b["y"]).alias("adjacent"), S.adjacent_within(a["x"], a["y"], b["x"], b["y"]).alias("near"), S.inside_frame(a, 90, 70).alias("inside"))


@query("f21_first_bin", f"{W} SELECT game_id, idx, CASE WHEN b < 8 THEN b END AS bin FROM (SELECT *, CAST(greatest(floor((value + 30) / 8), 0) AS INT) AS b FROM diffs)")
def _(spark, d):
    return X.differences(spark, d).select("game_id", "idx", S.first_bin(F.col("value"), F.lit(-30.0), F.lit(8.0), 8).alias("bin"))


@query("f23_rescale", "SELECT p_partkey, CASE WHEN p_size < 25 THEN 9 ELSE 9 * p_size // 25 END AS width, CASE WHEN p_size < 25 THEN 9 * 25 // p_size ELSE 9 END AS height FROM part")
def _(spark, d):
    return X.table(spark, d, "part").select("p_partkey", S.rescale(F.col("p_size"), F.lit(25), F.lit(9)).alias("r")).select("p_partkey", "r.*")


@query("f22_f27_squares_and_boxes", f"{W} SELECT game_id, idx, round(power(amplitude, 2), 6) AS square, CAST(trunc(amplitude / 3) AS INT) AS x, CAST(trunc(-amplitude / 7) AS INT) AS y FROM samples")
def _(spark, d):
    a = F.col("amplitude")
    b = S.box(a / 3, -a / 7, F.lit(1.0), F.lit(1.0))
    return X.samples(spark, d).select("game_id", "idx", F.round(F.pow(a, 2), 6).alias("square"), b["x"].alias("x"), b["y"].alias("y"))


@query("f25_file_names", f"{W} SELECT DISTINCT 'Game#' || game_id || '_Auto_i15_s3.txt' AS name FROM samples")
def _(spark, d):
    return X.signals(spark, d).select(text.file_name(F.col("game_id"), 15, 3.0).alias("name")).distinct()


# --- 2.6: windows ---------------------------------------------------------------------------------------------------
@query("w1_smooth_in_place", f"{R}, {X.smoothing()} SELECT game_id, idx, round(value, 6) AS value FROM smooth")
def _(spark, d):
    return signal.smooth(X.differences(spark, d)).select("game_id", "idx", r6("value", "value"))


@query("w2_smooth_amplitude", f"{R}, {X.smoothing(2, 'samples', value='amplitude')} SELECT game_id, idx, round(value, 6) AS value FROM smooth")
def _(spark, d):
    return signal.smooth(X.samples(spark, d).select("game_id", "idx", F.col("amplitude").alias("value")), 2).select("game_id", "idx", r6("value", "value"))


@query("w3_smooth_trailing", f"""{R}, w_x AS (SELECT game_id, list(value ORDER BY idx) AS x, count(*) AS n FROM diffs GROUP BY 1),
w_r AS (SELECT game_id, 0 AS i, CAST([] AS DOUBLE[]) AS acc FROM w_x UNION ALL
  SELECT r.game_id, r.i + 1, list_append(r.acc, CASE WHEN r.i < 3 THEN a.x[r.i + 1] ELSE (a.x[r.i + 1] + r.acc[r.i] + r.acc[r.i - 1] + r.acc[r.i - 2]) / 4 END) FROM w_r r JOIN w_x a USING (game_id) WHERE r.i < a.n)
SELECT game_id, unnest(range(n)) AS idx, unnest(list_transform(acc, lambda v: round(v, 6))) AS value FROM w_r JOIN w_x USING (game_id) WHERE i = n""")
def _(spark, d):
    return signal.smooth_trailing(X.differences(spark, d)).select("game_id", "idx", r6("value", "value"))


@query("w4_smooth_pair", f"""{W}, n AS (SELECT game_id, count(*) AS n FROM samples GROUP BY 1), k AS (SELECT unnest(range(-5, 6)) AS k)
SELECT s.game_id, s.idx, s.frame_number, CAST(trunc(sum(t.l_matches) / 11.0) AS INT) AS l_matches, CAST(trunc(sum(t.r_matches) / 11.0) AS INT) AS r_matches
FROM samples s JOIN n USING (game_id), k JOIN samples t ON t.game_id = s.game_id AND t.idx = least(greatest(s.idx + k.k, 0), n.n - 1) GROUP BY ALL""")
def _(spark, d):
    return signal.smooth_pair(X.signals(spark, d))


@query("w5_smooth_directions", f"""{R}, w_x AS (SELECT game_id, list(value ORDER BY idx) AS x, count(*) AS n FROM diffs GROUP BY 1),
w_r AS (SELECT game_id, 0 AS i, CAST([] AS DOUBLE[]) AS acc FROM w_x UNION ALL
  SELECT r.game_id, r.i + 1, list_append(r.acc, ((CASE WHEN r.i = 0 THEN a.x[1] ELSE r.acc[r.i] END) + a.x[r.i + 1] + a.x[least(r.i + 2, a.n)]) / 3) FROM w_r r JOIN w_x a USING (game_id) WHERE r.i < a.n)
SELECT game_id, unnest(range(n)) AS idx, unnest(list_transform(acc, lambda v: round(v, 6))) AS value FROM w_r JOIN w_x USING (game_id) WHERE i = n""")
def _(spark, d):
    return signal.smooth_directions(X.differences(spark, d)).select("game_id", "idx", r6("value", "value"))


_O = "WINDOW o AS (PARTITION BY game_id ORDER BY idx)"


@query("w6_w7_gradients", f"{W} SELECT game_id, idx, CASE WHEN lag(value) OVER o IS NULL AND lead(value) OVER o IS NULL THEN value ELSE abs(coalesce(lag(value) OVER o, value) - coalesce(lead(value) OVER o, value)) END AS gradient, coalesce(abs(value - lag(value) OVER o), 0) AS difference FROM diffs {_O}")
def _(spark, d):
    return signal.first_difference(signal.gradient(X.differences(spark, d))).select("game_id", "idx", "gradient", "difference")


@query("w8_running_sums", f"{W}, g AS (SELECT *, CASE WHEN lag(value) OVER o IS NULL AND lead(value) OVER o IS NULL THEN value ELSE abs(coalesce(lag(value) OVER o, value) - coalesce(lead(value) OVER o, value)) END AS g FROM diffs {_O}), s AS (SELECT *, coalesce(abs(g - lag(g) OVER o), g) AS s FROM g {_O}) SELECT game_id, idx, sum(value) OVER o AS agg_max, sum(s) OVER o AS agg_grad FROM s {_O}")
def _(spark, d):
    return signal.running_sums(signal.gradient(X.differences(spark, d))).select("game_id", "idx", "agg_max", "agg_grad")


@query("w9_ahead_difference", f"{W} SELECT game_id, idx, lead(value, 5) OVER o - value AS ahead FROM diffs {_O}")
def _(spark, d):
    return signal.ahead_difference(X.differences(spark, d)).select("game_id", "idx", "ahead")


@query("w10_mean_ahead", f"{W} SELECT game_id, idx, round(avg(value) OVER o, 6) AS mean_ahead, avg(value) OVER o >= 2 AS stays_positive FROM diffs WINDOW o AS (PARTITION BY game_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)")
def _(spark, d):
    return rounded(signal.mean_ahead(X.differences(spark, d)).select("game_id", "idx", "mean_ahead", "stays_positive"))


@query("w11_w12_look_ahead", f"""{W}, b AS (SELECT *, abs(value) >= 20 AS outside, value <= -20 AS r FROM diffs)
SELECT game_id, idx, min(CAST(outside AS INT)) OVER (PARTITION BY game_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 1 AS continuous,
CAST(coalesce(min(CASE WHEN r THEN idx END) OVER f - idx, 4) AS INT) AS step, min(CASE WHEN r THEN idx END) OVER f IS NULL AS none FROM b
WINDOW f AS (PARTITION BY game_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""")
def _(spark, d):
    df = signal.all_outside_band(X.differences(spark, d), 0.0, 20.0)
    return signal.none_on_side(df, "RIGHT", 0.0, 20.0).select("game_id", "idx", "continuous", "step", "none")


@query("w13_still_sides", f"""{W}, m AS (SELECT *, CASE WHEN motion <> 'STILL' THEN motion END AS moved FROM samples),
n AS (SELECT *, last_value(moved IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(moved IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM m)
SELECT game_id, idx, frame_number, motion, CASE WHEN motion <> 'STILL' THEN NULL WHEN b IS NOT NULL THEN (CASE b WHEN 'MOVINGRIGHT' THEN 'RIGHT' ELSE 'LEFT' END) WHEN a IS NOT NULL THEN (CASE a WHEN 'MOVINGLEFT' THEN 'RIGHT' ELSE 'LEFT' END) END AS side FROM n""")
def _(spark, d):
    return signal.still_sides(X.motions(spark, d))


@query("w14_inherited_sides", O.INHERITED_SIDES)
def _(spark, d):
    return signal.inherited_sides(X.motions(spark, d))


@query("w15_gaps", f"{W}, {X.TRUE_SEGMENTS} SELECT * FROM (SELECT game_id, end_frame + 1 AS start_frame, lead(start_frame) OVER (PARTITION BY game_id ORDER BY start_frame) - 1 AS end_frame FROM trues) WHERE end_frame IS NOT NULL")
def _(spark, d):
    return segments.gaps(X.true_segments(spark, d))


# --- 2.9: runs, validation, markers -----------------------------------------------------------------------------
RUNS = """p AS (SELECT *, value >= 0 AS pos FROM smooth), c AS (SELECT *, pos <> lag(pos) OVER o AS ch, lead(value) OVER o AS nx, max(idx) OVER (PARTITION BY game_id) AS top FROM p WINDOW o AS (PARTITION BY game_id ORDER BY idx)),
u AS (SELECT *, coalesce(sum(CAST(ch AS INT)) OVER (PARTITION BY game_id ORDER BY idx), 0) AS run_id FROM c),
runs AS (SELECT game_id, CAST(run_id AS INT) AS run_id, min(idx) AS start_idx, max(idx) AS end_idx, bool_and(pos) AS is_positive,
  greatest(0, coalesce(max(value) FILTER (NOT coalesce(ch, false)), 0)) AS max_mag, least(0, coalesce(min(value) FILTER (NOT coalesce(ch, false)), 0)) AS min_mag,
  CAST(abs(trunc(coalesce(sum(trunc(value)) FILTER (NOT coalesce(ch, false) AND idx > 0), 0) + coalesce(last(nx ORDER BY idx), 0))) AS INT) AS auc, max(top) AS top FROM u GROUP BY game_id, run_id HAVING min(idx) <> max(top))"""
_SR = f"{R}, {X.smoothing()}, {RUNS}"


def _runs(spark, d):
    return segments.sign_runs(signal.smooth(X.differences(spark, d)))


@query("q1_sign_runs", f"{_SR} SELECT game_id, run_id, start_idx, end_idx, is_positive, round(max_mag, 6) AS max_mag, round(min_mag, 6) AS min_mag, auc FROM runs")
def _(spark, d):
    return rounded(_runs(spark, d))


@query("a2_a3_run_means", f"{_SR} SELECT game_id, is_positive, round(avg(CASE WHEN is_positive THEN max_mag ELSE -min_mag END), 6) AS avg_mag, round(avg(auc), 6) AS avg_auc, count(*) AS n_runs FROM runs GROUP BY 1, 2")
def _(spark, d):
    return rounded(segments.run_means(_runs(spark, d)))


@query("q2_validate_runs", f"{O.valid_runs(_SR)} SELECT game_id, run_id, start_idx, end_idx, is_positive, round(max_mag, 6) AS max_mag, round(min_mag, 6) AS min_mag, auc, valid FROM runs JOIN valid USING (game_id, run_id)")
def _(spark, d):
    return rounded(segments.validate_runs(_runs(spark, d)))


@query("f7_normalise_runs", f"{_SR} SELECT s.game_id, run_id, s.idx, idx * 15 + 1 AS frame_number, is_positive, round(coalesce(value / nullif(CASE WHEN is_positive THEN max_mag ELSE abs(min_mag) END, 0), 0), 6) AS value FROM smooth s JOIN runs r ON s.game_id = r.game_id AND s.idx BETWEEN r.start_idx AND r.end_idx")
def _(spark, d):
    smooth = signal.smooth(X.differences(spark, d))
    return rounded(segments.normalise_runs(smooth, segments.sign_runs(smooth)))


def _thresholds(enter: float, leave: float, valid: bool = False) -> str:
    only = "JOIN valid t ON t.game_id = r.game_id AND t.run_id = r.run_id AND t.valid" if valid else ""
    return f"""{O.valid_runs(_SR) if valid else _SR}, m AS (SELECT s.game_id, r.run_id, s.idx, is_positive, coalesce(abs(value / nullif(CASE WHEN is_positive THEN max_mag ELSE abs(min_mag) END, 0)), 0) AS a FROM smooth s JOIN runs r ON s.game_id = r.game_id AND s.idx BETWEEN r.start_idx AND r.end_idx {only}),
l AS (SELECT *, coalesce(lag(a) OVER w, 0) AS b, lead(a) OVER w AS n FROM m WINDOW w AS (PARTITION BY game_id, run_id ORDER BY idx)),
f AS (SELECT game_id, run_id, min(idx) FILTER (a > {enter} AND a > b) AS hit, max_by(a, idx) AS fin FROM l GROUP BY 1, 2),
e AS (SELECT l.*, hit, coalesce((SELECT b FROM l x WHERE x.game_id = l.game_id AND x.run_id = l.run_id AND x.idx = hit), fin) AS carried FROM l JOIN f USING (game_id, run_id)),
g AS (SELECT game_id, run_id, any_value(is_positive) AS pos, coalesce(any_value(hit), min(idx)) AS i, coalesce(max(idx) FILTER (a > {leave} AND a > coalesce(n, carried)), max(idx)) AS j FROM e GROUP BY 1, 2)
SELECT game_id, run_id, i * 15 + 1 AS start_frame, j * 15 + 1 AS end_frame, CASE WHEN pos THEN 'L' ELSE 'R' END AS side, CAST((j - i) * 15 AS INT) AS length FROM g"""


@query("q2b_threshold_segments", _thresholds(0.5, 0.3))
def _(spark, d):
    smooth = signal.smooth(X.differences(spark, d))
    return segments.threshold_segments(segments.normalise_runs(smooth, segments.sign_runs(smooth)))


@query("q2b_single_threshold", _thresholds(0.3, 0.3))
def _(spark, d):
    smooth = signal.smooth(X.differences(spark, d))
    return segments.threshold_segments(segments.normalise_runs(smooth, segments.sign_runs(smooth)), 0.3, 0.3)


@query("lc1_find_segments", _thresholds(0.5, 0.3, True))
def find_segments(spark, d):
    return segments.find_segments(X.differences(spark, d))


@query("q3_dead_band_markers", O.dead_band(0.0, 12.0) + " SELECT * FROM marks")
def _(spark, d):
    return segments.dead_band_markers(signal.smooth(X.differences(spark, d)), 0.0, 12.0)


@query("q3_u4_dead_band_segments", O.dead_band(0.0, 12.0) + ", n AS (SELECT *, row_number() OVER o AS no, lead(frame_number) OVER o AS end_frame FROM marks WINDOW o AS (PARTITION BY game_id ORDER BY frame_number, status)) SELECT game_id, frame_number AS start_frame, end_frame, CASE WHEN status = 'LEFT_START' THEN 'L' ELSE 'R' END AS side, CAST(end_frame - frame_number AS INT) AS length FROM n WHERE no % 2 = 1 AND end_frame IS NOT NULL")
def _(spark, d):
    return segments.pair_markers(segments.dead_band_markers(signal.smooth(X.differences(spark, d)), 0.0, 12.0))


@query("q4_zero_crossings", O.ZERO_CROSSINGS)
def _(spark, d):
    return segments.zero_crossings(signal.smooth(X.differences(spark, d)))


@query("u4_pair_markers", f"{W}, k AS (SELECT game_id, frame_number, CASE WHEN phase = 0 THEN 'LEFT_START' ELSE 'RIGHT_START' END AS status FROM samples WHERE idx % 5 = 0), n AS (SELECT *, row_number() OVER o AS no, lead(frame_number) OVER o AS end_frame FROM k WINDOW o AS (PARTITION BY game_id ORDER BY frame_number, status)) SELECT game_id, frame_number AS start_frame, end_frame, CASE WHEN status = 'LEFT_START' THEN 'L' ELSE 'R' END AS side, CAST(end_frame - frame_number AS INT) AS length FROM n WHERE no % 2 = 1 AND end_frame IS NOT NULL")
def _(spark, d):
    return segments.pair_markers(X.samples(spark, d).where("idx % 5 = 0").select("game_id", "frame_number", F.when(F.col("phase") == 0, "LEFT_START").otherwise("RIGHT_START").alias("status")))


@query("a6_histogram_bounds", f"""{W}, h AS (SELECT game_id, value >= 0 AS pos, CAST(least(trunc(abs(value) / 10), 9) AS INT) AS bin, count(*) AS n FROM diffs GROUP BY 1, 2, 3),
a AS (SELECT DISTINCT game_id, pos, b AS bin FROM diffs, (SELECT unnest([true, false]) AS pos), (SELECT unnest(range(10)) AS b)), x AS (SELECT a.*, coalesce(n, 0) AS n FROM a LEFT JOIN h USING (game_id, pos, bin)),
y AS (SELECT *, lag(n) OVER (PARTITION BY game_id, pos ORDER BY bin) - n AS fall FROM x)
SELECT game_id, CAST(coalesce(-10 * max(bin) FILTER (NOT pos AND fall > 5), -1) AS DOUBLE) AS low, CAST(coalesce(10 * max(bin) FILTER (pos AND fall > 5), 1) AS DOUBLE) AS high FROM y GROUP BY 1""")
def _(spark, d):
    return signal.histogram_bounds(X.differences(spark, d), drop=5)


@query("a18_run_quality", f"""{_SR}, v AS (SELECT s.game_id, run_id, s.idx, CAST(l_matches - r_matches AS DOUBLE) AS v, coalesce(abs((l_matches - r_matches) / CAST(nullif(l_matches + r_matches, 0) AS DOUBLE)), 0) * 100 AS share FROM samples s JOIN runs r ON s.game_id = r.game_id AND s.idx BETWEEN r.start_idx AND r.end_idx), g AS (SELECT *, abs(v - lag(v) OVER w) AS g, abs(share - lag(share) OVER w) AS gs FROM v WINDOW w AS (PARTITION BY game_id, run_id ORDER BY idx))
SELECT game_id, run_id, round(median(share), 6) AS median_share, median(abs(v)) AS median_value, sum(abs(v)) AS sum_value, max(abs(v)) AS max_value, max(g) AS max_gradient, round(avg(g), 6) AS avg_gradient, round(max(gs), 6) AS max_share_gradient, round(avg(share), 6) AS avg_share, round(max(share), 6) AS max_share, round((max(abs(v)) - min(abs(v))) / nullif(max(abs(v)) + min(abs(v)), 0), 6) AS spread FROM g GROUP BY 1, 2""")
def _(spark, d):
    return rounded(segments.run_quality(X.signals(spark, d), _runs(spark, d)))


@query("a20_top_mean", f"{W}, m AS (SELECT game_id, abs(value) AS a, max(abs(value)) OVER (PARTITION BY game_id) AS t FROM diffs) SELECT game_id, round(avg(a), 6) AS top_mean FROM m WHERE a >= 0.9 * t GROUP BY 1")
def _(spark, d):
    return rounded(segments.top_mean(X.differences(spark, d)))


# --- 2.4 and 2.9: evaluation ---------------------------------------------------------------------------------------
@query("j10_a19_ball_entry_scores", """WITH g AS (SELECT user_id AS s, count(*) AS g FROM events WHERE event_type = 'purchase' GROUP BY 1), d AS (SELECT user_id AS s, count(*) AS d FROM events WHERE event_type = 'click' AND event_id % 5 <> 0 GROUP BY 1),
b AS (SELECT coalesce(g, 0) AS g, coalesce(d, 0) AS d FROM g FULL JOIN d USING (s)), c AS (SELECT sum(least(g, d)) AS tp, sum(greatest(d - g, 0)) AS fp, sum(greatest(g - d, 0)) AS fn FROM b)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, tp / CAST(tp + fp AS DOUBLE) AS "precision", tp / CAST(tp + fn AS DOUBLE) AS recall FROM c""")
def _(spark, d):
    e = X.table(spark, d, "events")
    truth = e.where("event_type = 'purchase'").select(F.col("user_id").alias("segment_id"), F.col("event_id").alias("frame"))
    found = e.where("event_type = 'click'").select(F.col("user_id").alias("segment_id"), F.when(F.col("event_id") % 5 == 0, -1).otherwise(F.col("event_id")).alias("frame"))
    return evaluate.ball_entry_scores(truth, found)


@query("j9_q9b_transition_scores", O.TRANSITION_SCORES)
def _(spark, d):
    return evaluate.transition_scores(X.truth_markers(spark, d), segments.zero_crossings(signal.smooth(X.differences(spark, d))))


@query("j11_q7_segment_scores", O.SEGMENT_SCORES)
def _(spark, d):
    return evaluate.segment_scores(X.truth_markers(spark, d), X.found_segments(spark, d))


@query("j12_q8_segment_scores_between", O.SEGMENT_SCORES_BETWEEN)
def _(spark, d):
    return evaluate.segment_scores_between(X.truth_markers(spark, d), X.found_segments(spark, d))


@query("j8_q9_agreement", O.AGREEMENT)
def _(spark, d):
    return rounded(evaluate.agreement(X.true_segments(spark, d), X.found_segments(spark, d)))


@query("j8_overlaps", f"{W}, {X.FOUND}, {X.TRUE_SEGMENTS} SELECT f.game_id, f.start_frame, f.end_frame, f.side, CAST(sum(least(f.end_frame, t.end_frame) - greatest(f.start_frame, t.start_frame)) AS BIGINT) AS covered, count(*) AS met, round(sum(least(f.end_frame, t.end_frame) - greatest(f.start_frame, t.start_frame)) / CAST(f.end_frame - f.start_frame AS DOUBLE), 6) AS share FROM found f JOIN trues t ON f.game_id = t.game_id AND f.side = t.side AND f.start_frame <= t.end_frame AND t.start_frame <= f.end_frame GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return rounded(evaluate.overlaps(X.true_segments(spark, d), X.found_segments(spark, d)))


@query("j7_boxes_with_truth", f"WITH {X.BOXES} SELECT b.game_id, b.frame_number, t.x AS true_x FROM boxes b LEFT JOIN (SELECT * FROM boxes WHERE frame_number % 2 = 0) t USING (game_id, frame_number)")
def _(spark, d):
    b = X.boxes(spark, d)
    return boxes.with_truth(b, b.where("frame_number % 2 = 0")).select("game_id", "frame_number", F.col("true_box.x").alias("true_x"))


@query("j15_frames_of_segments", f"{W}, {X.FOUND} SELECT s.game_id, s.frame_number, f.start_frame, f.end_frame, f.side FROM samples s JOIN found f ON s.game_id = f.game_id AND s.frame_number BETWEEN f.start_frame AND f.end_frame")
def _(spark, d):
    return boxes.frames_of_segments(X.samples(spark, d).select("game_id", "frame_number"), X.found_segments(spark, d).drop("length"))


@query("q10_tracked", O.TRACKED)
def _(spark, d):
    b = X.boxes(spark, d).select(F.col("game_id").alias("segment_id"), F.col("frame_number").alias("frame"), "box")
    reference = b.groupBy("segment_id").agg(F.min_by("box", "frame").alias("ref"))
    lost, seen = (F.col("box.x") + F.col("box.y")) % 3 == 0, F.col("box.y") % 2 == 0
    frames = b.withColumns({"found": F.when(seen, F.col("box")), "box": F.when(~lost, F.col("box"))})
    return boxes.tracked(frames, reference, 130, 100, 2).select("segment_id", "frame", F.col("box.x").alias("x"))


# --- 2.4, 2.5: matching ---------------------------------------------------------------------------------------------
_DIST = f"WITH {X.FEATURES}, n AS (SELECT t.image_id, r.image_id AS ref_id, t.feature_id, r.feature_id AS match_id, array_distance(t.descr::DOUBLE[64], r.descr::DOUBLE[64]) ** 2 AS d FROM features t JOIN features r ON t.image_id <> r.image_id {{where}}), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, ref_id, feature_id ORDER BY d, match_id) AS no FROM n), m AS (SELECT a.image_id, a.ref_id, a.feature_id, a.match_id, a.d AS distance FROM k a JOIN k b ON a.image_id = b.image_id AND a.ref_id = b.ref_id AND a.feature_id = b.feature_id AND a.no = 1 AND b.no = 2 WHERE a.d < b.d * 0.9)"


@query("j1_t5_matches", _DIST.format(where="") + " SELECT image_id, ref_id, feature_id, match_id, round(distance, 6) AS distance FROM m")
def _(spark, d):
    f = X.features(spark, d)
    return rounded(match.matches(f, f, 0.9))


@query("a1_three_part_signal", _DIST.format(where="AND r.image_id < 3") + " SELECT image_id, count(*) FILTER (ref_id = 0) AS l_matches, count(*) FILTER (ref_id = 1) AS r_matches, count(*) FILTER (ref_id = 2) AS m_matches FROM m GROUP BY 1")
def _(spark, d):
    f = X.features(spark, d)
    return match.signals(match.match_counts(match.matches(f.where("image_id < 3"), f, 0.9)), 0, 1, 2)


@query("j2_j4_pair_matches", _DIST.format(where="AND t.image_id < r.image_id") + " SELECT image_id AS a, ref_id AS b, count(*) AS matches, count(*) >= 3 AS matched FROM m GROUP BY 1, 2")
def _(spark, d):
    return match.pair_matches(X.features(spark, d), 0.9, 3)


@query("j4_u2_k11_edges", _DIST.format(where="AND t.image_id < r.image_id") + ", e AS (SELECT image_id AS a, ref_id AS b FROM m GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e")
def _(spark, d):
    return match.similarity_edges(match.pair_matches(X.features(spark, d), 0.9, 3))


@query("j5_consecutive_pairs", _DIST.format(where="AND r.image_id = t.image_id + 1") + ", o AS (SELECT image_id AS a, lead(image_id) OVER (ORDER BY image_id) AS b FROM (SELECT DISTINCT image_id FROM features)), c AS (SELECT image_id AS a, ref_id AS b, count(*) AS n FROM m GROUP BY 1, 2) SELECT a, b, coalesce(n, 0) AS matches, coalesce(n, 0) >= 3 AS matched FROM o LEFT JOIN c USING (a, b) WHERE b IS NOT NULL")
def _(spark, d):
    return match.pair_matches(X.features(spark, d), 0.9, 3, consecutive=True)


@query("j3_a4_f11_flow_medians", _DIST.format(where="AND r.image_id = t.image_id + 1") + ", f AS (SELECT m.image_id, m.ref_id, r.x - t.x AS x, r.y - t.y AS y FROM m JOIN features t ON t.image_id = m.image_id AND t.feature_id = m.feature_id JOIN features r ON r.image_id = m.ref_id AND r.feature_id = m.match_id), g AS (SELECT image_id, ref_id, median(atan2(y, x)) AS direction, median(sqrt(x*x+y*y)) AS magnitude FROM f GROUP BY 1, 2) SELECT image_id, ref_id, round(direction, 6) AS direction, round(magnitude, 6) AS magnitude, CASE WHEN magnitude < 100 THEN 'STILL' WHEN abs(direction) < pi() / 2 THEN 'MOVINGRIGHT' ELSE 'MOVINGLEFT' END AS motion FROM g")
def _(spark, d):
    f = X.features(spark, d)
    next_ones = match.neighbours(f).where("b = a + 1").select(F.col("a").alias("image_id"), F.col("b").alias("ref_id"))
    return rounded(match.flow_medians(match.match_flow(match.matches(f, f, 0.9, next_ones), f)))


@query("k11_edge_file", _DIST.format(where="AND t.image_id < r.image_id") + ", e AS (SELECT image_id AS a, ref_id AS b FROM m GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e")
def _(spark, d):
    path = scratch(spark, "edges")
    text.write_edges(match.similarity_edges(match.pair_matches(X.features(spark, d), 0.9, 3)), path)
    return spark.read.csv(path, sep=" ", schema="src long, dst long")


@query("a5_circular_mean", f"WITH {X.FEATURES} SELECT image_id, round(atan2(avg(sin(a)), avg(cos(a))), 6) AS mean_direction, round(var_pop(cos(a)) + var_pop(sin(a)), 6) AS variance FROM (SELECT image_id, atan2(y - 90, x - 160) AS a FROM features) GROUP BY 1")
def _(spark, d):
    f = X.features(spark, d).select("image_id", F.atan2(F.col("y") - 90, F.col("x") - 160).alias("a"))
    return rounded(match.circular_mean(f, ["image_id"], "a"))


@query("a7_bounds", f"{W} SELECT game_id, min(value) AS low, max(value) AS high FROM diffs GROUP BY 1")
def _(spark, d):
    return X.differences(spark, d).groupBy("game_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))


@query("j14_first_of_each", f"{W} SELECT game_id, min(frame_number) AS frame_number, arg_min(motion, frame_number) AS motion FROM samples GROUP BY 1")
def _(spark, d):
    return match.first_of_each(X.motions(spark, d), "game_id", "frame_number").select("game_id", "frame_number", "motion")


# --- 2.9: camera ------------------------------------------------------------------------------------------------------
@query("q5_camera_candidates", O.CAMERA_CANDIDATES + " SELECT * FROM cands")
def _(spark, d):
    return camera.camera_candidates(X.motions(spark, d))


@query("q5a_simple_candidates", O.SIMPLE_CANDIDATES)
def _(spark, d):
    return camera.simple_candidates(X.motions(spark, d))


@query("t6_first_candidates", O.CAMERA_CANDIDATES + ", z AS (SELECT *, CAST(row_number() OVER (PARTITION BY game_id ORDER BY start_idx, end_idx) AS INT) AS no FROM cands) SELECT * FROM z WHERE no <= 2")
def _(spark, d):
    return camera.first_candidates(camera.camera_candidates(X.motions(spark, d)), 2)


@query("j13_t2_least_motion", f"{W}, c AS (SELECT game_id, idx AS start_idx, idx + 6 AS end_idx FROM samples WHERE idx % 10 = 0), m AS (SELECT c.*, s.idx, s.amplitude AS magnitude, row_number() OVER (PARTITION BY c.game_id, start_idx, end_idx ORDER BY s.amplitude, s.idx) AS no FROM c JOIN samples s ON s.game_id = c.game_id AND s.idx BETWEEN start_idx AND end_idx) SELECT game_id, start_idx, end_idx, idx, magnitude FROM m WHERE no = 1")
def _(spark, d):
    s = X.samples(spark, d)
    return camera.least_motion(s.where("idx % 10 = 0").select("game_id", F.col("idx").alias("start_idx"), (F.col("idx") + 6).alias("end_idx")), s.select("game_id", "idx", F.col("amplitude").alias("magnitude")))


@query("c3_representatives", f"{W}, c AS (SELECT game_id, idx AS s, idx + 6 AS e, phase FROM samples WHERE idx % 10 = 0) SELECT DISTINCT game_id, CAST(phase AS INT) AS side_index, unnest([s, e]) AS idx FROM c")
def _(spark, d):
    s = X.samples(spark, d).where("idx % 10 = 0")
    return camera.representatives(s.select("game_id", F.col("idx").alias("start_idx"), (F.col("idx") + 6).alias("end_idx"), F.when(F.col("phase") == 0, "RIGHT").otherwise("LEFT").alias("side")))


# --- 2.10: clusters ----------------------------------------------------------------------------------------------------
def _similar(s):
    s = s.select("game_id", F.col("idx").alias("i"), "event_id")
    a, b = s.select("game_id", F.col("i").alias("a"), F.col("event_id").alias("ea")), s.select("game_id", F.col("i").alias("b"), F.col("event_id").alias("eb"))
    return a.join(b, "game_id").where("a < b").select("game_id", "a", "b", ((F.col("ea") * 7 + F.col("eb") * 13) % 120).alias("matches"))


_SIMILAR = f"{W}, p AS (SELECT x.game_id, x.idx AS a, y.idx AS b, (x.event_id * 7 + y.event_id * 13) % 120 AS matches FROM samples x JOIN samples y ON x.game_id = y.game_id AND x.idx < y.idx)"


@query("c1_leader_clusters", O.LEADER_CLUSTERS)
def _(spark, d):
    s = X.samples(spark, d)
    return cluster.leader_clusters(_similar(s), s.select("game_id", F.col("idx").alias("image_id")))


@query("c1b_consecutive_clusters", f"{W} SELECT game_id, idx AS image_id, CAST(sum(CASE WHEN m < 80 THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY idx) AS INT) AS cluster FROM (SELECT game_id, idx, CASE WHEN idx > 0 THEN event_id * 7 % 120 END AS m FROM samples)")
def _(spark, d):
    s = X.samples(spark, d).select("game_id", F.col("idx").alias("image_id"), F.when(F.col("idx") > 0, F.col("event_id") * 7 % 120).alias("matches"))
    return cluster.consecutive_clusters(s)


@query("a13_t1_largest_clusters", f"{W}, c AS (SELECT game_id, CAST(event_id % 4 AS INT) AS cluster, count(*) AS size FROM samples GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY game_id ORDER BY size DESC, cluster) AS INT) AS rank FROM c) SELECT * FROM r WHERE rank <= 2")
def _(spark, d):
    return cluster.cluster_sizes(X.samples(spark, d).select("game_id", (F.col("event_id") % 4).cast("int").alias("cluster")), 2)


@query("c2_a14_t3_best_of_clusters", _SIMILAR + """, c AS (SELECT game_id, idx AS image_id, CAST(event_id % 3 AS INT) AS cluster FROM samples), e AS (SELECT p.game_id, x.cluster, unnest([a, b]) AS image_id, matches FROM p JOIN c x ON x.game_id = p.game_id AND x.image_id = a JOIN c y ON y.game_id = p.game_id AND y.image_id = b AND y.cluster = x.cluster),
t AS (SELECT game_id, cluster, image_id, CAST(sum(matches) AS BIGINT) AS total FROM e GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY game_id, cluster ORDER BY total DESC, image_id) AS no FROM t), z AS (SELECT game_id, cluster, count(*) AS size, row_number() OVER (PARTITION BY game_id ORDER BY count(*) DESC, cluster) AS r FROM c GROUP BY 1, 2)
SELECT k.game_id, k.cluster, k.image_id, k.total, z.size FROM k JOIN z USING (game_id, cluster) WHERE no = 1 AND r <= 2""")
def _(spark, d):
    s = X.samples(spark, d)
    return cluster.best_of_clusters(_similar(s), s.select("game_id", F.col("idx").alias("image_id"), (F.col("event_id") % 3).cast("int").alias("cluster")))


@query("c4_t8_u1_merge_clusters", O.MERGE_CLUSTERS)
def _(spark, d):
    s = X.samples(spark, d)
    h = s.select("game_id", F.col("idx").alias("candidate"), F.array(*(((F.col("event_id") * k) % 50).cast("double") for k in (3, 7, 11))).alias("histogram"))
    return cluster.merge_clusters(h)


@query("c5_page_rank", """WITH e AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM supplier JOIN customer ON s_suppkey % 25 = c_custkey % 25 AND s_nationkey <> c_nationkey), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS ways FROM e GROUP BY 1), c AS (SELECT count(*) AS n FROM n),
"""
+ ",\n".join([f"r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM n, c)"] + [f"r{i} AS (SELECT node, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(got, 0) + lost / c.n) AS rank FROM n LEFT JOIN (SELECT dst, sum(rank / ways) AS got FROM e JOIN r{i - 1} ON node = src JOIN o USING (src) GROUP BY 1) g ON n.node = g.dst, c, (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE node NOT IN (SELECT src FROM o)) l)" for i in range(1, 4)])
+ " SELECT node, round(rank, 6) AS rank FROM r3")
def _(spark, d):
    # Distinct keys of both sides first: 25 times 25 at most, whatever the scale.
    s = X.table(spark, d, "supplier").select((F.col("s_suppkey") % 25).alias("k"), F.col("s_nationkey").alias("src")).distinct()
    c = X.table(spark, d, "customer").select((F.col("c_custkey") % 25).alias("k"), F.col("c_nationkey").alias("dst")).distinct()
    e = s.join(c, "k").where("src <> dst").select("src", "dst").distinct()
    return rounded(cluster.page_rank(e, rounds=3))


# --- 2.5, 2.10: cells ---------------------------------------------------------------------------------------------------
@query("e6_cells", "SELECT CAST(i * 8 + j AS INT) AS cell_idx, CAST(trunc(i * (320 - 64.0) / 7) AS INT) AS x, CAST(trunc(j * (180 - 45.0) / 7) AS INT) AS y, 64 AS w, 45 AS h FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)")
def _(spark, d):
    return grid.cells(spark, 320, 180).select("cell_idx", "box.*")


@query("j6_neighbours", "WITH g AS (SELECT CAST(i * 5 + j AS INT) AS k, i * 64 AS x, j * 36 AS y FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j)) SELECT a.k AS cell_idx, b.k AS neighbour FROM g a JOIN g b ON a.k <> b.k AND abs(a.x - b.x) <= 64 AND abs(a.y - b.y) <= 36")
def _(spark, d):
    return grid.neighbours(grid.cells(spark, 320, 180, "even"))


@query("a9_active_cells", f"{W}, {X.CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY segment_id, frame ORDER BY mean DESC, cell_idx) AS no, avg(mean) OVER (PARTITION BY segment_id, frame) AS av FROM cells) SELECT segment_id, frame, cell_idx, round(mean - av, 6) AS amplitude FROM k WHERE no = 1")
def _(spark, d):
    return rounded(grid.active_cells(X.cells_of(spark, d)))


@query("a10_spatial_gradient", f"""{W}, {X.CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY segment_id, frame ORDER BY mean DESC, cell_idx) AS no, avg(mean) OVER (PARTITION BY segment_id, frame) AS av FROM cells)
SELECT a.segment_id, a.frame, a.cell_idx, round(a.mean - a.av, 6) AS amplitude, round(abs((a.mean - a.av) - avg(b.mean - b.av)), 6) AS s_grad FROM k a JOIN k b ON a.no = 1 AND a.segment_id = b.segment_id AND a.frame = b.frame AND b.cell_idx <> a.cell_idx AND abs(b.cell_idx - a.cell_idx) <= 1 GROUP BY a.segment_id, a.frame, a.cell_idx, a.mean, a.av""")
def _(spark, d):
    near = spark.range(9).select(F.col("id").cast("int").alias("cell_idx"), F.explode(F.sequence(F.greatest(F.col("id") - 1, F.lit(0)), F.least(F.col("id") + 1, F.lit(8)))).alias("neighbour")).withColumn("neighbour", F.col("neighbour").cast("int")).where("cell_idx <> neighbour")
    means = X.cells_of(spark, d)
    return rounded(grid.spatial_gradient(grid.active_cells(means), means, near))


def _amplitudes(spark, d):
    return X.samples(spark, d).select(F.col("game_id").alias("segment_id"), F.col("idx").alias("frame"), "amplitude")


@query("a11_mean_amplitude", f"{W} SELECT game_id AS segment_id, round(avg(amplitude), 6) AS avg_max_mag FROM samples GROUP BY 1")
def _(spark, d):
    return rounded(grid.mean_amplitude(_amplitudes(spark, d)))


@query("a12_t4_adaptive_threshold", f"{W}, k AS (SELECT game_id, amplitude, row_number() OVER (PARTITION BY game_id ORDER BY amplitude DESC, idx) AS no, floor(round(count(*) OVER (PARTITION BY game_id) * 0.15, 9)) AS k FROM samples) SELECT game_id AS segment_id, round(avg(amplitude) FILTER (no <= k), 6) AS threshold FROM k GROUP BY 1")
def _(spark, d):
    return rounded(grid.adaptive_threshold(_amplitudes(spark, d)))


@query("k7_e11_t7_cell_vectors", f"{W}, {X.CELLS}, m AS (SELECT segment_id, frame, avg(mean) AS av, max(mean) AS mx, list(mean) AS l FROM cells GROUP BY 1, 2) SELECT segment_id, frame, list_sort(list_transform(l, lambda v: round((v - av) / (mx - av), 6))) AS vector FROM m")
def _(spark, d):
    v = grid.cell_vectors(X.cells_of(spark, d))
    return v.select("segment_id", "frame", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def _frames(s):
    return s.select(F.col("game_id").alias("segment_id"), F.col("idx").alias("frame"), "event_id")


def _vectors(frames):
    """A coarse flow field of one vector every 20 pixels for each frame."""
    px = frames.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(143)))).withColumns({"px": F.floor(F.col("i") / 9) * 20 + 10, "py": F.col("i") % 9 * 20 + 10})
    return px.withColumn("magnitude", (F.col("event_id") * 13 + F.col("i") * F.col("i") * 7) % 101 / 10.0).drop("event_id", "i")


def _flow(s):
    return _vectors(_frames(s))


_FLOW = f"{W}, flow AS (SELECT game_id AS segment_id, idx AS frame, (i // 9) * 20 + 10 AS px, i % 9 * 20 + 10 AS py, ((event_id * 13 + i * i * 7) % 101) / 10.0::DOUBLE AS magnitude FROM samples, (SELECT unnest(range(144)) AS i))"


@query("a8_cell_means", f"{_FLOW}, g AS (SELECT CAST(i * 5 + j AS INT) AS cell_idx, i * 64 AS x, j * 36 AS y FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j)) SELECT segment_id, frame, cell_idx, round(avg(magnitude), 6) AS mean FROM flow JOIN g ON px >= x AND px < x + 64 AND py >= y AND py < y + 36 GROUP BY 1, 2, 3")
def _(spark, d):
    return rounded(grid.cell_means(_flow(X.samples(spark, d)), grid.cells(spark, 320, 180, "even")))


_REFINED = f"""{_FLOW}, g AS (SELECT CAST(i * 8 + j AS INT) AS cell_idx, CAST(trunc(i * (320 - 64.0) / 7) AS INT) AS x, CAST(trunc(j * (180 - 45.0) / 7) AS INT) AS y FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)),
cm AS (SELECT segment_id, frame, cell_idx, round(avg(magnitude), 9) AS mean FROM flow JOIN g ON px >= x AND px < x + 64 AND py >= y AND py < y + 45 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY segment_id, frame ORDER BY mean DESC, cell_idx) AS no, avg(mean) OVER (PARTITION BY segment_id, frame) AS av FROM cm),
act AS (SELECT segment_id, frame, cell_idx, x, y FROM k JOIN g USING (cell_idx) WHERE no = 1 AND greatest(0, mean) - av > 1.5),
pts AS (SELECT 0 AS sample, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy UNION ALL SELECT CAST((r - 1) * 8 + n + 1 AS INT), round(r * 20 / 3.0::DOUBLE * cos((n + (r % 2) / 2.0::DOUBLE) * pi() / 4), 4), round(r * 20 / 3.0::DOUBLE * sin((n + (r % 2) / 2.0::DOUBLE) * pi() / 4), 4) FROM (SELECT unnest([1, 2, 3]) AS r), (SELECT unnest(range(8)) AS n)),
mv AS (SELECT segment_id, frame, cell_idx, sample, trunc(x + dx) AS x, trunc({{y0}} + dy) AS y FROM act, pts),
mm AS (SELECT segment_id, frame, cell_idx, sample, round(avg(magnitude), 9) AS mean FROM mv JOIN flow USING (segment_id, frame) WHERE x >= 0 AND y >= 0 AND x + 64 < 320 AND y + 45 < 180 AND px >= x AND px < x + 64 AND py >= y AND py < y + 45 GROUP BY 1, 2, 3, 4),
best AS (SELECT *, row_number() OVER (PARTITION BY segment_id, frame ORDER BY mean DESC, sample) AS no FROM mm WHERE mean > 0)
SELECT segment_id, frame, act.cell_idx, coalesce(sample, 0) AS sample, round(coalesce(mean, 0), 6) AS mean FROM act LEFT JOIN (SELECT segment_id, frame, sample, mean FROM best WHERE no = 1) USING (segment_id, frame)"""


def _refined(spark, d, compat):
    # Dealt by frame over all partitions: few bytes go in, but each frame comes to thousands of rows.
    f = _frames(X.samples(spark, d)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "segment_id", "frame")
    g = grid.cells(spark, 320, 180)
    means = grid.cell_means(_vectors(f), g).withColumn("mean", F.round("mean", 9))
    return rounded(grid.refine(grid.active_cells(means), g, f, grid.radial_points(spark), 320, 180, compat=compat, expand=_vectors))


@query("e7_refine", _REFINED.format(y0="y"))
def _(spark, d):
    return _refined(spark, d, False)


@query("e7_refine_compat", _REFINED.format(y0="CASE WHEN sample = 0 THEN y ELSE x END"))
def _(spark, d):
    return _refined(spark, d, True)


# --- 2.10: ball entries -------------------------------------------------------------------------------------------------
_WINDOWS = f"""{R}, {X.smoothing(2, 'samples', value='amplitude')}, g AS (SELECT *, CASE WHEN lag(value) OVER o IS NULL AND lead(value) OVER o IS NULL THEN value ELSE abs(coalesce(lag(value) OVER o, value) - coalesce(lead(value) OVER o, value)) END AS g FROM smooth {_O}), st AS (SELECT *, coalesce(abs(g - lag(g) OVER o), g) AS st FROM g {_O}), a AS (SELECT *, sum(value) OVER o AS am, sum(st) OVER o AS ag, count(*) OVER (PARTITION BY game_id) AS n FROM st {_O}),
w AS (SELECT x.game_id, x.idx, CASE WHEN x.n < 150 THEN 20 ELSE 30 END AS size, x.idx AS s, y.idx AS e, y.am - x.am AS m, y.ag - x.ag AS g FROM a x JOIN a y ON x.game_id = y.game_id AND y.idx = x.idx + (CASE WHEN x.n < 150 THEN 20 ELSE 30 END) WHERE x.idx % ((CASE WHEN x.n < 150 THEN 20 ELSE 30 END) // 2) = 0)"""
_SPLIT = O.split_windows(_WINDOWS, 1.2, 0.05)


@query("e1_windows", f"""{_WINDOWS}
SELECT game_id AS segment_id, idx, size, s AS start_frame, e AS end_frame, round(m, 5) AS gain_max, round(g, 5) AS gain_grad FROM w QUALIFY count(*) OVER (PARTITION BY game_id) >= 2""")
def _(spark, d):
    w = ballentry.windows(ballentry.amplitude_features(_amplitudes(spark, d)))
    return w.select("segment_id", "idx", "size", "start_frame", "end_frame", F.round("gain_max", 5).alias("gain_max"), F.round("gain_grad", 5).alias("gain_grad"))


@query("e3_e4_split_windows", f"{_SPLIT} SELECT * FROM split")
def _(spark, d):
    return ballentry.split_windows(ballentry.windows(ballentry.amplitude_features(_amplitudes(spark, d))), 1.2, 0.05)


@query("u3_merge_windows", f"{W}, s AS (SELECT game_id AS segment_id, idx, frame_number AS start_frame, frame_number + 60 + event_id % 90 AS end_frame FROM samples WHERE idx % 6 = 0), l AS (SELECT *, coalesce(CASE WHEN lag(end_frame) OVER o <= start_frame THEN 1 ELSE 0 END, 1) AS nw FROM s WINDOW o AS (PARTITION BY segment_id ORDER BY start_frame, end_frame)), i AS (SELECT *, CASE WHEN idx = 0 THEN 0 ELSE 0 END + sum(nw) OVER (PARTITION BY segment_id ORDER BY start_frame, end_frame) AS island FROM l) SELECT segment_id, min(start_frame) AS start_frame, arg_max(end_frame, start_frame) AS end_frame, min(idx) AS idx, 20 AS size FROM i GROUP BY segment_id, island")
def _(spark, d):
    s = X.samples(spark, d).where("idx % 6 = 0").select(F.col("game_id").alias("segment_id"), "idx", F.col("frame_number").alias("start_frame"), (F.col("frame_number") + 60 + F.col("event_id") % 90).alias("end_frame"), F.lit(20).alias("size"))
    return ballentry.merge_windows(s)


@query("lc3_e0_e5_ball_entries", f"{_SPLIT}, {O.STRONGEST_MOMENTS}")
def _(spark, d):
    series = ballentry.amplitude_features(_amplitudes(spark, d))
    merged = ballentry.merge_windows(ballentry.split_windows(ballentry.windows(series), 1.2, 0.05))
    return ballentry.with_missing(ballentry.strongest_moment(merged, series), series)


@query("q6_entry_runs", O.ENTRY_RUNS)
def _(spark, d):
    a = _amplitudes(spark, d).withColumn("box", F.struct(*(F.lit(v).alias(n) for v, n in ((0, "x"), (0, "y"), (10, "w"), (10, "h")))))
    return ballentry.entry_runs(a, grid.adaptive_threshold(_amplitudes(spark, d), 0.6), run=3, apart=10)


# --- 2.5: histograms ----------------------------------------------------------------------------------------------------
@query("a15_edge_counts", "SELECT l_orderkey AS image_id, CAST((l_partkey % 640) // 128 AS INT) AS cx, CAST((l_suppkey % 360) // 72 AS INT) AS cy, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2, 3")
def _(spark, d):
    li = X.table(spark, d, "lineitem")
    return histograms.edge_counts(li.select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 640).alias("px"), (F.col("l_suppkey") % 360).alias("py"), (F.col("l_linenumber") % 2).alias("edge")))


@query("a16_colour_histogram", "WITH p AS (SELECT l_orderkey AS image_id, l_partkey % 300 AS y, l_suppkey % 256 AS cb, l_linenumber * 30 AS cr FROM lineitem) SELECT image_id, CASE WHEN y < 256 THEN CAST((floor(y / 32.0) * 12 + floor(cb / (256 / 12.0))) * 12 + floor(cr / (256 / 12.0)) AS INT) END AS bin, count(*) AS n FROM p GROUP BY 1, 2")
def _(spark, d):
    li = X.table(spark, d, "lineitem")
    return histograms.colour_histogram(li.select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 300).cast("double").alias("y"), (F.col("l_suppkey") % 256).cast("double").alias("cb"), (F.col("l_linenumber") * 30).cast("double").alias("cr")))


@query("a17_mean_histograms", "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k FROM embeddings), m AS (SELECT label, k, avg(v) AS v FROM e GROUP BY 1, 2) SELECT label, list(round(v, 6) ORDER BY k) AS histogram FROM m GROUP BY 1")
def _(spark, d):
    h = X.table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("histogram"))
    return histograms.mean_histograms(h, ["label"]).select("label", F.transform("histogram", lambda x: F.round(x, 6)).alias("histogram"))
