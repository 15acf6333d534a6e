"""Worked values, and the grouped operators against literal loops."""

import random

from courtlens.functions import folds

LEFT = [40] * 12 + [25, 10, 5] + [2] * 10 + [8, 20] + [45] * 10 + [6] * 3 + [3] * 8 + [12, 30, 50, 50, 50, 30, 10, 5, 2, 2]
RIGHT = [5] * 12 + [8, 10, 20] + [45] * 10 + [30, 20] + [4] * 10 + [7] * 3 + [30] * 8 + [12, 5, 3, 3, 3, 6, 10, 15, 20, 25]
PLAYS = [(1, 151, "L"), (226, 346, "R"), (406, 541, "L"), (601, 676, "R"), (721, 781, "L"), (826, 856, "R")]


def test_smoothing_is_recursive():
    x = [3, -1, 4, 1, -5, 9, -2, 6, 5, -3, 5, 8, -9]
    y = folds.smooth_in_place(x)
    assert [round(v, 6) for v in y[:3]] == [2.363636, 1.619835, 2.18858]
    assert round(y[-1], 6) == -5.096057
    assert folds.smooth_in_place([]) == [] and folds.smooth_in_place([4.0]) == [4.0]


def test_validation_of_runs():
    m = [40, -30, 5, -25, 10, -8, 15, -31, 38, -12, 9]
    valid = folds.valid_runs([v > 0 for v in m], [abs(v) for v in m])
    assert valid == [True, True, False] + [True] * 8


def test_dead_band_markers():
    v = [0.9, 0.8, 0.7, 0.5, 0.1, 0, 0.1, 0.2, -0.1, -0.5, -0.9, -0.8, -0.2, 0, 0, 0, 0, 0]
    assert folds.dead_band_markers(v, 0.0, 0.4) == [(0, "LEFT_START"), (3, "LEFT_END"), (9, "RIGHT_START"), (11, "RIGHT_END")]


def test_crossing_keeps_what_was_looked_at_last():
    assert folds.crossing([0.1, 0.6, 1.0, 0.4, 0.2]) == (1, 3)
    assert folds.crossing([0.0]) == (0, 0)


def test_zero_crossings_need_what_follows():
    v = [5.0] * 10 + [-5.0] * 10 + [5.0] * 10
    assert folds.zero_crossings(v, list(range(30))) == [9, 20]
    assert folds.zero_crossings([5.0, -1.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0], list(range(9))) == []


def test_camera_rests():
    m = ["MOVINGRIGHT"] * 2 + ["STILL"] * 4 + ["MOVINGLEFT"] * 3
    assert folds.camera_candidates(m) == [(2, 5, "RIGHT")]
    assert folds.camera_candidates(["MOVINGRIGHT"] + ["STILL"] * 40 + ["MOVINGLEFT"] * 3) == []
    assert folds.simple_candidates(m) == 1


def test_scores():
    assert folds.match_segments([10, 20, 30], [5, 25]) == (2, 1, 0)
    assert folds.match_once([100, 500], [90, 300, 510], 105)[0] == 2
    assert folds.match_between([0, 20, 40], [10, 30, 50], [15, 35]) == (2, 1, 0)
    percent, extra, missed = folds.agreement([(0, 10, "L"), (20, 30, "R")], [(0, 10, "L"), (22, 32, "R")])
    assert (round(percent, 6), extra, missed) == (90.0, 0, 0)


def test_clusters():
    assert folds.leader_clusters([0, 1, 2, 3], {(0, 2), (1, 2)}) == {0: 0, 2: 0, 1: 1, 3: 2}
    merged = folds.merge_clusters({"a": [0, 0], "b": [1, 0], "c": [10, 0], "d": [20, 0]}, 3)
    assert merged == [("c", 1), ("d", 1), ("a_b", 2)]
    labels, _ = folds.two_means([(0, 0), (1, 0), (10, 0), (11, 0)])
    assert labels[0] == labels[1] != labels[2] == labels[3]


def test_merged_clusters_are_those_of_a_literal_loop():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 9, 25):
        for most in (4, 1000):
            h = {str(i): [float(rng.randrange(6)) for _ in range(3)] for i in range(n)}
            held = [(k, 1, v) for k, v in h.items()]
            while len(held) > 3:
                d, i, j = min((sum((a - b) ** 2 for a, b in zip(x[2], y[2])) ** 0.5, i, j) for i, x in enumerate(held) for j, y in enumerate(held) if i < j)
                if d >= most / 2:
                    break
                x, y = held[i], held[j]
                held = [c for c in held if c not in (x, y)] + [(f"{x[0]}_{y[0]}", x[1] + y[1], [(a + b) / 2 for a, b in zip(x[2], y[2])])]
            assert folds.merge_clusters(h, 3, most / 2) == [c[:2] for c in held]


def test_ball_entries():
    box = [(0, 0, 10, 10)] * 8
    assert folds.ball_entries(list(range(8)), [0, 5, 5, 5, 5, 5, 5, 0], box, 1.0) == [1]


def test_find_segments_is_the_chain_of_its_parts(spark):
    from courtlens.operators import segments, signal

    random.seed(3)
    rows = [(0, i, 1 + 15 * i, float(a - b)) for i, (a, b) in enumerate(zip(LEFT, RIGHT, strict=True))]
    for g in range(1, 25):
        v = 0.0
        for i in range(random.randint(2, 90)):
            v = 0.9 * v + random.uniform(-15, 15)
            rows.append((g, i, 1 + 15 * i, v))
    df = spark.createDataFrame(rows, "game_id int, idx long, frame_number long, value double").repartition(7)
    whole = {(r.game_id, r.run_id): (r.start_frame, r.end_frame, r.side) for r in segments.find_segments(df).collect()}
    smooth = signal.smooth(df)
    runs = segments.validate_runs(segments.sign_runs(smooth)).where("valid")
    parts = {(r.game_id, r.run_id): (r.start_frame, r.end_frame, r.side) for r in segments.threshold_segments(segments.normalise_runs(smooth, runs)).collect()}
    assert whole == parts
    assert [whole[0, i] for i in range(6)] == PLAYS


def test_homography_survives_wrong_matches():
    import numpy as np

    from courtlens.operators import panorama

    rng = np.random.default_rng(1)
    h = np.array([[1.1, 0.05, 4], [-0.03, 0.9, 2], [1e-4, 2e-4, 1]])
    a = rng.uniform(0, 200, (40, 2))
    b = panorama.apply(h, a)
    b[::5] += 50
    got, inliers = panorama.consensus(a, b, 0.5)
    assert inliers == 32 and np.allclose(got, h, atol=1e-6)


def test_options():
    from courtlens.plans import options

    program, o = options.parse(["segments", "--signals", "in", "--out", "out", "--enter", "0.6"])
    assert program == "segments" and (o.signals, o.enter, o.leave) == ("in", 0.6, 0.3)
