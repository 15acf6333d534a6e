"""Homographies between images from their matches: direct linear transform with random sample consensus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import fold


def _fit(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The matrix that takes points a to b, from four pairs or more."""
    zero, one = np.zeros(len(a)), np.ones(len(a))
    x, y, u, v = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
    h = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def apply(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.hstack([points, np.ones((len(points), 1))]) @ h.T
    return p[:, :2] / np.where(np.abs(p[:, 2:]) < 1e-12, 1e-12, p[:, 2:])


def consensus(a: np.ndarray, b: np.ndarray, within: float = 3.0, rounds: int = 200, seed: int = 7) -> tuple[np.ndarray | None, int]:
    """(matrix, inliers): the best of ``rounds`` samples of four pairs, fitted again to all pairs that agree with it."""
    best, rng = np.zeros(len(a), bool), np.random.default_rng(seed)
    if len(a) < 4:
        return None, 0
    for _ in range(rounds):
        pick = rng.choice(len(a), 4, replace=False)
        h = _fit(a[pick], b[pick])
        if h is not None:
            ok = np.hypot(*(apply(h, a) - b).T) <= within
            if ok.sum() > best.sum():
                best = ok
    if best.sum() < 4:
        return None, int(best.sum())
    return _fit(a[best], b[best]), int(best.sum())


def homographies(found: DataFrame, points: DataFrame, within: float = 3.0, rounds: int = 200) -> DataFrame:
    """(image_id, ref_id, h, inliers) of each image pair; ``h`` has nine numbers by row, or is null."""
    t = points.select("image_id", "feature_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    r = points.select(F.col("image_id").alias("ref_id"), F.col("feature_id").alias("match_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))

    def step(p: pd.DataFrame) -> pd.DataFrame:
        h, n = consensus(p[["tx", "ty"]].to_numpy(float), p[["rx", "ry"]].to_numpy(float), within, rounds)
        return pd.DataFrame({"h": [None if h is None else h.ravel().tolist()], "inliers": [n]})

    return fold(found.join(t, ["image_id", "feature_id"]).join(r, ["ref_id", "match_id"]), ["image_id", "ref_id"], ["feature_id"], step, "h array<double>, inliers int")
