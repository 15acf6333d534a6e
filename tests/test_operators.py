"""Small worked cases of the DataFrame operators, sources and the stream."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from courtlens.functions import folds
from courtlens.functions import scalar as S
from courtlens.operators import ballentry, boxes, evaluate, grid, match, segments, signal
from courtlens.plans.registry import QUERIES
from courtlens.sources import text


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_ball_entry_scores(spark):
    g = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6)], "segment_id int, frame long").where("segment_id <> 1")
    d = spark.createDataFrame([(0, 1), (2, 9), (4, 1), (4, 2), (3, -1)], "segment_id int, frame long")
    assert rows(evaluate.ball_entry_scores(g, d), "tp") == [(2, 2, 2, 0.5, 0.5)]


def test_windows_of_a_segment(spark):
    for n, expected in ((25, []), (41, [(0, 20), (10, 30), (20, 40)])):
        s = spark.range(n).select(F.lit(1).alias("segment_id"), F.col("id").alias("idx"), F.col("id").alias("frame"), F.col("id").cast("double").alias("agg_max"), F.col("id").cast("double").alias("agg_grad"))
        assert [(r.start_frame, r.end_frame) for r in ballentry.windows(s).orderBy("idx").collect()] == expected


def test_merged_windows_and_touching_ones(spark):
    s = spark.createDataFrame([(1, 0, 20, 100, 120), (1, 1, 20, 110, 130), (1, 2, 20, 140, 160), (2, 0, 20, 100, 120), (2, 1, 20, 120, 140)], "segment_id int, idx long, size int, start_frame long, end_frame long")
    assert [(r.segment_id, r.start_frame, r.end_frame) for r in ballentry.merge_windows(s).orderBy("segment_id", "start_frame").collect()] == [(1, 100, 130), (1, 140, 160), (2, 100, 120), (2, 120, 140)]


def test_gradient_and_threshold(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([5.0, 7.0, 4.0, 10.0])], "game_id int, idx long, value double")
    assert [r.gradient for r in signal.gradient(df).orderBy("idx").collect()] == [2, 1, 3, 6]
    a = spark.createDataFrame([(1, i, float(i)) for i in range(1, 21)] + [(2, i, 1.0) for i in range(6)], "segment_id int, frame long, amplitude double")
    assert rows(grid.adaptive_threshold(a), "segment_id") == [(1, 19.0), (2, None)]


def test_still_sides(spark):
    m = ["STILL", "STILL", "MOVINGRIGHT", "STILL", "MOVINGLEFT", "STILL"]
    df = spark.createDataFrame([(0, i, i, v) for i, v in enumerate(m)], "game_id int, idx long, frame_number long, motion string")
    assert [r.side for r in signal.still_sides(df).orderBy("idx").collect()] == ["LEFT", "LEFT", None, "RIGHT", None, "LEFT"]


def test_boxes_touch_at_edges(spark):
    b = lambda *v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, "xywh", strict=True)))
    assert spark.range(1).select(S.touching(b(0, 0, 10, 10), b(10, 0, 5, 5))).first()[0] is True


def test_matching_and_edges(spark):
    f = spark.createDataFrame([(0, 0, 0.0, 0.0, [0.0, 0.0]), (0, 1, 1.0, 1.0, [9.0, 9.0]), (1, 2, 5.0, 5.0, [0.1, 0.0]), (1, 3, 6.0, 6.0, [5.0, 4.0])], "image_id long, feature_id long, x double, y double, descr array<double>")
    found = match.matches(f, f, 0.49).where("image_id = 1")
    assert [(r.feature_id, r.match_id) for r in found.collect()] == [(2, 0)]
    edges = match.similarity_edges(match.pair_matches(f, 0.49, 1))
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 0)]


def test_text_readers(spark, tmp_path):
    (tmp_path / "Game#7_seg.txt").write_text("1 151 L\n226 346 R\n400 500 x\n\n")
    got = text.segments(spark, str(tmp_path / "Game#7_seg.txt"))
    assert rows(got, "start_frame") == [(7, 1, 151, "L", 150), (7, 226, 346, "R", 120), (7, 400, 500, "R", 100)]
    (tmp_path / "boxes.txt").write_text("10 20 30 40\n200 21 31 41\n")
    assert [tuple(r.box) for r in text.reference_boxes(spark, str(tmp_path / "boxes.txt")).orderBy("side").collect()] == [(10, 20, 30, 40), (200, 21, 31, 41)]
    (tmp_path / "h.txt").write_text("a 1 2\nb 3 4\n\n")
    assert [(r.candidate, r.histogram) for r in text.histograms(spark, str(tmp_path / "h.txt")).orderBy("candidate").collect()] == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    out = os.path.join(str(tmp_path), "out")
    text.write_segments(got, out)
    assert rows(text.segments(spark, out), "start_frame") == rows(got, "start_frame")


def test_segments_of_markers(spark):
    m = spark.createDataFrame([(0, 1, "LEFT_START"), (0, 46, "LEFT_END"), (0, 136, "RIGHT_START"), (0, 166, "RIGHT_END"), (0, 200, "LEFT_START")], "game_id int, frame_number long, status string")
    assert [(r.start_frame, r.end_frame, r.side) for r in segments.pair_markers(m).orderBy("start_frame").collect()] == [(1, 46, "L"), (136, 166, "R")]


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    from courtlens.operators.camera import camera_candidates as batch
    from courtlens.streaming.camera import camera_candidates as stream

    m = (["MOVINGRIGHT"] * 3 + ["STILL"] * 4 + ["MOVINGLEFT"] * 3 + ["STILL"] * 4) * 3
    data = [(g, i, i, v) for g in (1, 2) for i, v in enumerate(m)]
    schema = "game_id long, idx long, frame_number long, motion string"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("rests").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rests").collect())) == sorted(map(tuple, batch(spark.createDataFrame(data, schema)).collect()))


def test_queries_without_sql_take_every_sample_of_a_game(spark, tmp_path):
    n = {1: 30, 2: 7}
    events = [(100 * u + i, i, u, "a", 1.0) for u in n for i in range(n[u])]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = {u: {} for u in n}
    for r in QUERIES["c1_leader_clusters"](spark, str(tmp_path)).collect():
        found[r.game_id][r.image_id] = r.cluster
    for u in n:
        close = {(a, b) for a in range(n[u]) for b in range(a + 1, n[u]) if ((100 * u + a) * 7 + (100 * u + b) * 13) % 120 >= 80}
        assert found[u] == folds.leader_clusters(list(range(n[u])), close)
    members = {}
    for r in QUERIES["c4_t8_u1_merge_clusters"](spark, str(tmp_path)).collect():
        members.setdefault(r.game_id, []).append(r.members)
    assert {u: (len(m), sum(m)) for u, m in members.items()} == {u: (3, n[u]) for u in n}
    assert {(r.segment_id, r.frame) for r in QUERIES["e7_refine"](spark, str(tmp_path)).select("segment_id", "frame").collect()} == {(u, i) for u in n for i in range(n[u])}


def _events(spark, tmp_path, n):
    events = [(100 * u + i, i, u, "a", 1.0) for u in n for i in range(n[u])]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def _joins_of_frames(df):
    """How the plan joins tables that grow with the frames."""
    return re.findall(r"(\w+Join) \[segment_id", df._jdf.queryExecution().sparkPlan().toString())


def test_refinement_broadcasts_no_flow(spark, tmp_path):
    df = QUERIES["e7_refine"](spark, _events(spark, tmp_path, {1: 30, 2: 7}))
    assert _joins_of_frames(df) == ["SortMergeJoin"] and df.count() == 37


def test_compat_refinement_broadcasts_no_flow(spark, tmp_path):
    df = QUERIES["e7_refine_compat"](spark, _events(spark, tmp_path, {1: 30, 2: 7}))
    assert _joins_of_frames(df) == ["SortMergeJoin"] and df.count() == 37


def _tables_broadcast(df):
    """What a table is read for in the broadcasts of a plan that has been run, as first planned and as changed on the way."""
    lines = [(len(re.match(r"[\s:+-]*", x).group()), x) for x in df._jdf.queryExecution().executedPlan().toString().split("\n")]
    found, inside = [], None
    for depth, x in lines:
        inside = None if inside is not None and depth <= inside else inside
        if inside is not None and "Scan parquet" in x:
            found.append(x)
        inside = depth if inside is None and re.search(r"\bBroadcastExchange\b", x) else inside
    return found


@pytest.mark.parametrize("name", ["e7_refine", "e7_refine_compat"])
def test_no_broadcast_of_a_refinement_reads_a_table(spark, tmp_path, name):
    df = QUERIES[name](spark, _events(spark, tmp_path, {1: 30, 2: 7}))
    assert len(df.collect()) == 37
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Scan parquet" in plan and _tables_broadcast(df) == []


def test_refinement_of_rows_that_stand_for_many_vectors(spark):
    g, points = grid.cells(spark, 320, 180), grid.radial_points(spark)
    frames = spark.range(12).select((F.col("id") % 3).alias("segment_id"), F.floor(F.col("id") / 3).alias("frame"), F.col("id").alias("seed"))
    spread = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(143)))).select("*", (F.floor(F.col("i") / 9) * 20 + 10).alias("px"), (F.col("i") % 9 * 20 + 10).alias("py"), ((F.col("seed") * 13 + F.col("i") * F.col("i") * 7) % 101 / 10.0).alias("magnitude"))
    active = frames.select("segment_id", "frame", (F.col("seed") * 5 % 64).cast("int").alias("cell_idx"), F.lit(2.0).alias("amplitude"))
    nowhere = active.limit(1).withColumn("segment_id", F.lit(9).cast("long"))
    for compat in (False, True):
        rows, many = (grid.refine(active.union(nowhere), g, f, points, 320, 180, compat=compat, expand=e).collect() for f, e in ((spread(frames), None), (frames, spread)))
        assert sorted(rows) == sorted(many) and len(rows) == 13
        assert [(r.sample, r.mean) for r in rows if r.segment_id == 9] == [(0, 0.0)]


def test_vectors_meet_the_cells_that_hold_them(spark):
    rng = random.Random(8)
    cells = [(0, 0, 0, 16, 16), (1, 15, 15, 1, 1), (2, -20, -5, 40, 30), (3, 16, 32, 0, 5), (4, 3, 7, 100, 60)]
    flow = [(1, k % 2, rng.choice([rng.randint(-30, 110), rng.uniform(-30, 110)]) * 1.0, float(rng.choice([15, 16, rng.randint(-10, 70)])), float(k)) for k in range(400)]
    g = spark.createDataFrame(cells, "cell_idx int, x int, y int, w int, h int").select("cell_idx", F.struct("x", "y", "w", "h").alias("box"))
    got = {(r.frame, r.cell_idx): r.mean for r in grid.cell_means(spark.createDataFrame(flow, "segment_id int, frame int, px double, py double, magnitude double"), g).collect()}
    held = {(f, c): [m for _, t, px, py, m in flow if t == f and x <= px < x + w and y <= py < y + h] for f in (0, 1) for c, x, y, w, h in cells}
    assert got == pytest.approx({k: sum(v) / len(v) for k, v in held.items() if v})


def test_radial_points_and_the_frame(spark):
    p = {r.sample: (r.dx, r.dy) for r in grid.radial_points(spark).collect()}
    step = 20 / 3
    want = {0: (0.0, 0.0)}
    for ring in (1, 2, 3):
        for k in range(8):
            turn = k * math.pi / 4 + (math.pi / 8 if ring % 2 else 0)
            want[(ring - 1) * 8 + k + 1] = (ring * step * math.cos(turn), ring * step * math.sin(turn))
    assert p.keys() == want.keys() and all(abs(a - b) < 1e-3 for k in p for a, b in zip(p[k], want[k], strict=True))
    b = lambda *v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, "xywh", strict=True)))
    inside = [spark.range(1).select(S.inside_frame(b(*v), 100, 80)).first()[0] for v in ((0, 0, 99, 79), (0, 0, 100, 79), (-1, 0, 5, 5), (5, 1, 94, 79), (5, 0, 95, 10))]
    assert inside == [True, False, False, False, False]


def test_refinement_is_that_of_a_literal_loop(spark):
    rng = random.Random(3)
    width, height = 60, 50
    cells = [(0, 20, 15, 12, 10), (1, 2, 2, 12, 10), (2, 40, 30, 12, 10)]
    flow = [(s, 0, x, y, rng.random() * 5) for s in range(6) for x in range(0, width, 2) for y in range(0, height, 2)]
    active = [(s, 0, s % 3, 1.0 if s == 5 else 2.0) for s in range(6)]
    g = spark.createDataFrame(cells, "cell_idx int, x int, y int, w int, h int").select("cell_idx", F.struct("x", "y", "w", "h").alias("box"))
    f = spark.createDataFrame(flow, "segment_id int, frame int, px int, py int, magnitude double")
    a = spark.createDataFrame(active, "segment_id int, frame int, cell_idx int, amplitude double")
    for compat in (False, True):
        got = {r.segment_id: (r.sample, round(r.mean, 6)) for r in grid.refine(a, g, f, grid.radial_points(spark), width, height, compat=compat).collect()}
        want = {}
        for s, _, c, amplitude in active:
            if amplitude <= 1.5:
                continue
            _, x, y, w, h = cells[c]
            places = [(x, y)]
            for ring in (1, 2, 3):
                for k in range(8):
                    turn = k * math.pi / 4 + (ring % 2) * math.pi / 8
                    places.append((int(x + round(ring * 20 / 3 * math.cos(turn), 4)), int((x if compat else y) + round(ring * 20 / 3 * math.sin(turn), 4))))
            top, at = 0.0, 0
            for i, (sx, sy) in enumerate(places):
                if sx >= 0 and sy >= 0 and sx + w < width and sy + h < height:
                    own = [m for t, _, px, py, m in flow if t == s and sx <= px < sx + w and sy <= py < sy + h]
                    if own and sum(own) / len(own) > top:
                        top, at = sum(own) / len(own), i
            want[s] = (at, round(top, 6))
        assert got == want


def test_a_lost_tracker_starts_anew(spark):
    b = (10, 10, 10, 10)
    # Segment 1: start at the second look, lost at 7, found again at 7 + 2; segment 2: never; segment 3: lost for good.
    rows = [(1, f, None if f in (7, 8, 9) else b, b if f in (2, 4, 9) else None) for f in range(13)]
    rows += [(2, f, b, (200, 0, 10, 10)) for f in range(5)] + [(3, f, b if f < 3 else None, b if f == 0 else None) for f in range(6)]
    box = "struct<x:int,y:int,w:int,h:int>"
    frames = spark.createDataFrame(rows, f"segment_id int, frame long, box {box}, found {box}")
    ref = spark.createDataFrame([(s, b) for s in (1, 2, 3)], f"segment_id int, ref {box}")
    got = {}
    for r in boxes.tracked(frames, ref, 100, 100, 2).orderBy("frame").collect():
        got.setdefault(r.segment_id, []).append(r.frame)
    assert got == {1: [2, 3, 4, 5, 6, 9, 10, 11, 12], 2: [-2], 3: [0, 1, 2]}
    assert folds.track(3, lambda k: k == 3, lambda k: True, 1) == []


def test_windows_split_into_two_clusters(spark):
    strong = [(1, i, 20, i * 10, i * 10 + 20, 90.0 + i, 40.0) for i in range(2)]
    weak = [(1, i, 20, i * 10, i * 10 + 20, 5.0 + i / 10, 2.0) for i in range(2, 9)]
    even = [(2, i, 20, i * 10, i * 10 + 20, 5.0 + i / 100, 2.0) for i in range(6)]
    s = spark.createDataFrame(strong + weak + even, "segment_id int, idx long, size int, start_frame long, end_frame long, gain_max double, gain_grad double")
    assert rows(ballentry.split_windows(s).select("segment_id", "idx"), "segment_id", "idx") == [(1, 0), (1, 1)]


def test_the_strongest_moment_of_a_window(spark):
    gains = [float(i) for i in (*range(25), *range(60, 66))]
    series = spark.createDataFrame([(1, i, v) for i, v in enumerate(gains)], "segment_id int, idx long, agg_max double")
    merged = spark.createDataFrame([(1, 0, 20, 0, 30)], "segment_id int, idx long, size int, start_frame long, end_frame long")
    # Starts at 0, 5 and 10; the gain over 20 places is largest from 5 on (60 - 5); a third of 20 behind it.
    assert rows(ballentry.strongest_moment(merged, series), "frame") == [(1, 11)]
