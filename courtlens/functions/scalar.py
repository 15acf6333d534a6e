"""Column expressions: side signals, normalisation, flow vectors and boxes. All stay inside Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordinals of the marker kinds and of the motion kinds as files hold them.
STATUSES = ("START", "STILL", "LEFT2RIGHT", "RIGHT2LEFT", "TIMEOUT", "TRANSITION", "LEFT_START", "LEFT_END", "RIGHT_START", "RIGHT_END")
MOTIONS = ("STILL", "MOVINGRIGHT", "MOVINGLEFT")


# --- side signal ------------------------------------------------------------------------------------------------
def side_difference(left: Column, right: Column) -> Column:
    return (left - right).cast("double")


def normalised_difference(left: Column, right: Column) -> Column:
    """100 (l - r) / (l + r); null where both are 0."""
    return F.try_divide((left - right).cast("double"), (left + right).cast("double")) * 100


def is_right(v: Column) -> Column:
    """Right is negative; zero belongs to the left."""
    return v < 0


def is_left(v: Column) -> Column:
    return v >= 0


def side_in_band(v: Column, fraction: float | Column, offset: float | Column) -> Column:
    """RIGHT up to fraction - offset, LEFT from fraction + offset on, else MID."""
    f, o = (F.lit(x) if not isinstance(x, Column) else x for x in (fraction, offset))
    return F.when(v <= f - o, "RIGHT").when(v >= f + o, "LEFT").otherwise("MID")


def side_changed(v: Column, last: Column) -> Column:
    """Whether a sample lies on another side than ``last`` (0 left, 1 right)."""
    return (is_right(v) & (last != 1)) | (is_left(v) & (last != 0))


def normalise(v: Column, low: Column, high: Column, mode: int) -> Column:
    """Mode 0: to 0..1; 1: to -1..1; 2: each sign by its own bound; any other mode leaves values as they are."""
    if mode in (0, 1):
        bottom = 0.0 if mode == 0 else -1.0
        return bottom + F.try_divide((v - low) * (1.0 - bottom), high - low)
    if mode == 2:
        return F.when(v <= 0, -1 + F.try_divide(v - low, -low)).otherwise(F.try_divide(v, high))
    return v


def normalise_clamped(v: Column, low: Column, high: Column, mode: int) -> Column:
    """As :func:`normalise`, but mode 2 holds values beyond a bound at -1 or 1."""
    if mode == 2:
        return F.when(v < 0, F.when(v < low, -1.0).otherwise(F.try_divide(v, -low))).otherwise(F.when(v > high, 1.0).otherwise(F.try_divide(v, high)))
    return normalise(v, low, high, mode)


def normalise_in_run(v: Column, positive: Column, low: Column, high: Column) -> Column:
    """A run's values by its own largest magnitude; null where that is 0."""
    return F.when(positive, F.try_divide(v, high)).otherwise(F.try_divide(v, F.abs(low)))


def transition_band(mode: int, low: Column, high: Column) -> tuple[Column, Column]:
    """(fraction, offset) of the dead band."""
    if mode == 2:
        return F.lit(0.0), F.lit(0.4)
    return F.try_divide(-low, high - low), F.lit(0.045)


# --- flow -------------------------------------------------------------------------------------------------------
def magnitude(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def polar(x: Column, y: Column) -> Column:
    return F.struct(magnitude(x, y).alias("r"), F.atan2(y, x).alias("theta"))


def flow(tx: Column, ty: Column, rx: Column, ry: Column) -> Column:
    """From a matched point to its place in the reference: x, y, direction and magnitude."""
    x, y = (rx - tx).cast("double"), (ry - ty).cast("double")
    return F.struct(x.alias("x"), y.alias("y"), F.atan2(y, x).alias("direction"), magnitude(x, y).alias("magnitude"))


def camera_state(direction: Column, size: Column, still_below: float = 100.0) -> Column:
    half = math.pi / 2
    return F.when(size < still_below, "STILL").when((direction > -half) & (direction < half), "MOVINGRIGHT").otherwise("MOVINGLEFT")


def degrees(radians: Column, pi: float = 3.14159) -> Column:
    """With the shortened constant by default."""
    return radians * (180.0 / pi)


# --- boxes: structs of x, y, w, h -----------------------------------------------------------------------------------
def box(x, y, w, h) -> Column:
    """Whole numbers, cut towards zero."""
    return F.struct(*(F.col(c).cast("int").alias(n) if isinstance(c, str) else c.cast("int").alias(n) for c, n in zip((x, y, w, h), "xywh", strict=True)))


def valid_box(b: Column, ref: Column, width: int, height: int, tolerance: float = 0.75) -> Column:
    """Inside the frame, not empty, and not too different in size from the reference box."""
    inside = (b["x"] >= 0) & (b["y"] >= 0) & (b["w"] > 0) & (b["h"] > 0) & (b["x"] + b["w"] <= width) & (b["y"] + b["h"] <= height)
    return inside & (F.abs(b["w"] - ref["w"]) <= tolerance * ref["w"]) & (F.abs(b["h"] - ref["h"]) <= tolerance * ref["h"])


def touching(a: Column, b: Column) -> Column:
    """Whether two boxes meet; a shared edge is enough."""
    return (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"]) & (a["y"] <= b["y"] + b["h"]) & (b["y"] <= a["y"] + a["h"])


def _intersection(a: Column, b: Column, b_width: Column) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b_width) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def overlap_in_hull(a: Column, b: Column, compat: bool = False) -> Column:
    """The intersection's share of the smallest box around both. ``compat`` measures both boxes by the first one's width."""
    bw = a["w"] if compat else b["w"]
    wide = F.greatest(a["x"] + a["w"], b["x"] + bw) - F.least(a["x"], b["x"])
    high = F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - F.least(a["y"], b["y"])
    return F.try_divide(_intersection(a, b, bw).cast("double"), (wide * high).cast("double"))


def box_properties(a: Column, b: Column) -> Column:
    """Intersection over union, and the distance of the centres (of halves cut to whole numbers)."""
    both = _intersection(a, b, b["w"])
    iou = F.try_divide(both.cast("double"), (a["w"] * a["h"] + b["w"] * b["h"] - both).cast("double"))
    half = lambda v: F.floor(v / 2)
    dx = (a["x"] + half(a["w"])) - (b["x"] + half(b["w"]))
    dy = (a["y"] + half(a["h"])) - (b["y"] + half(b["h"]))
    return F.struct(iou.alias("iou"), F.sqrt((dx * dx + dy * dy).cast("double")).alias("distance"))


def moved_less_than(now: Column, before: Column, most: float = 1.0) -> Column:
    """Whether the centre's squared way from the box before is below ``most``; true for the first box."""
    dx = (now["x"] + now["w"] / 2) - (before["x"] + before["w"] / 2)
    dy = (now["y"] + now["h"] / 2) - (before["y"] + before["h"] / 2)
    return F.coalesce(dx * dx + dy * dy < most, F.lit(True))


def adjacent(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (F.abs(ax - bx) <= 1) & (F.abs(ay - by) <= 1)


def adjacent_within(ax: Column, ay: Column, bx: Column, by: Column, most: int = 3) -> Column:
    return F.abs(ax - bx) + F.abs(ay - by) <= most


def inside_frame(b: Column, width: int, height: int) -> Column:
    """Whether a box lies in the frame; its far edges must not touch the frame's."""
    return (b["x"] >= 0) & (b["y"] >= 0) & (b["x"] + b["w"] < width) & (b["y"] + b["h"] < height)


def first_bin(v: Column, low: Column, size: Column, bins: int) -> Column:
    """The first bin whose upper edge lies above ``v``: all below the range fall into bin 0; null beyond the last."""
    at = F.greatest(F.floor((v - low) / size), F.lit(0)).cast("int")
    return F.when(at < bins, at)


def rescale(width: Column, height: Column, smaller: Column) -> Column:
    """The smaller side becomes ``smaller``; the other follows in proportion, cut to a whole number."""
    w = F.when(width < height, smaller).otherwise((smaller * width / height).cast("int"))
    h = F.when(width < height, (smaller * height / width).cast("int")).otherwise(smaller)
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
