"""What one ordered series goes through step by step: pure functions over Python lists and numpy arrays.

These are the steps whose next state depends on the data, so no window frame expresses them. The operators run
them once for each game or segment, within one grouped stage.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np


def smooth_in_place(x: Sequence[float], w: int = 5) -> list[float]:
    """Mean of the w values before, which are smoothed already, and the value with the w after it.

    Places before the first value count as the first, places behind the last as the last.
    """
    y = [float(v) for v in x]
    top = len(y) - 1
    for i in range(len(y)):
        y[i] = sum(y[min(max(k, 0), top)] for k in range(i - w, i + w + 1)) / (2 * w + 1)
    return y


def smooth_trailing(x: Sequence[float]) -> list[float]:
    """Mean of a value and the three smoothed ones before it, from the fourth value on."""
    y = [float(v) for v in x]
    for i in range(3, len(y)):
        y[i] = sum(y[i - 3 : i + 1]) / 4
    return y


def smooth_directions(x: Sequence[float]) -> list[float]:
    """Mean of three neighbours, written to the middle one before the next is formed."""
    y = [float(v) for v in x]
    top = len(y) - 1
    for i in range(len(y)):
        y[i] = (y[max(i - 1, 0)] + y[i] + y[min(i + 1, top)]) / 3
    return y


def valid_runs(positive: Sequence[bool], size: Sequence[float]) -> list[bool]:
    """Which runs of a signed series are plays. ``size`` holds their largest magnitudes.

    A run as large as the mean of its sign is valid. When no later run of its sign exceeds the mean, the camera has
    changed: the mean is taken anew from this run on and the run is asked again. Else a run below three tenths of the
    mean is invalid, and any other is held against up to two valid runs before and two runs behind it.
    """
    n = len(size)
    of = lambda sign, start=0: [size[j] for j in range(start, n) if positive[j] == sign]
    mean = {s: sum(own) / len(own) if (own := of(s)) else 0.0 for s in (True, False)}
    valid, start = [False] * n, 0
    # The largest run of each sign from a place on.
    rest = {s: [0.0] * (n + 1) for s in (True, False)}
    for j in range(n - 1, -1, -1):
        for s in (True, False):
            rest[s][j] = max(rest[s][j + 1], size[j]) if bool(positive[j]) == s else rest[s][j + 1]
    for i in range(n):
        sign, resets = positive[i], 0
        while True:
            a = mean[sign]
            if size[i] >= a or resets > n:
                valid[i] = True
                break
            if rest[bool(sign)][i + 1] > a:
                if size[i] >= 0.3 * a:
                    before = [size[j] for j in range(i - 1, start - 1, -1) if valid[j] and positive[j] == sign][:2]
                    after = list(itertools.islice((size[j] for j in range(i + 1, n) if positive[j] == sign), 2))
                    near = before + after
                    valid[i] = size[i] > 0.3 * (sum(near) / len(near))
                break
            own = of(sign, i)
            mean[sign], start, resets = sum(own) / len(own), i, resets + 1
    return valid


def crossing(v: Sequence[float], enter: float = 0.5, leave: float = 0.3) -> tuple[int, int]:
    """First and last place of a run whose normalised magnitudes ``v`` are given.

    The start is the first value above ``enter`` that exceeds the one before; from the back, the end is the first value
    above ``leave`` that exceeds the one looked at before. What was looked at last when the start was found carries over.
    """
    last, first = 0.0, 0
    for i, a in enumerate(v):
        if a > enter and a > last:
            first = i
            break
        last = a
    end = len(v) - 1
    for i in range(len(v) - 1, -1, -1):
        if v[i] > leave and v[i] > last:
            return first, i
        last = v[i]
    return first, end


def dead_band_markers(v: Sequence[float], fraction: float, offset: float) -> list[tuple[int, str]]:
    """(place, status) where play settles on a side and where it leaves it.

    A side counts from a sample on whose next three, itself included, lie outside the band. A sample within the band
    ends it if none of five, itself included, lies on that side; the samples looked at are passed over either way.
    """
    n = len(v)
    right, left = fraction - offset, fraction + offset
    side = lambda a: "RIGHT" if a <= right else "LEFT" if a >= left else None
    out: list[tuple[int, str]] = []
    at, on = 0, None
    while at < n:
        here = side(v[at])
        if here:
            if on is None and all(side(v[min(k, n - 1)]) for k in range(at, at + 3)):
                on = here
                out.append((at, f"{here}_START"))
        elif on is not None:
            step = next((k for k in range(5) if side(v[min(at + k, n - 1)]) == on), None)
            if step is None:
                out.append((at - 1, f"{on}_END"))
                on, step = None, 4
            at += step
        at += 1
    return out


def zero_crossings(v: Sequence[float], frames: Sequence[int], ahead: int = 7, least: float = 2.0) -> list[int]:
    """Frames of sign changes that the mean of the next ``ahead`` samples confirms; those samples are then passed over."""
    n, out = len(v), []
    at, sign = 1, bool(n) and v[0] >= 0
    while at < n:
        now = v[at] >= 0
        if now != sign and (sum(v[min(at + k, n - 1)] for k in range(1, ahead + 1)) / ahead >= least) != sign:
            out.append(frames[at] if now else frames[at - 1])
            sign = now
            at += ahead
        else:
            at += 1
    return out


def camera_candidates(motions: Sequence[str], most_still: int = 30, compat: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, side) where the camera rests between a move and the opposite one.

    Rests are counted from their second sample on, over all rests since the last candidate. ``compat``: a rest that
    is given up for its length makes the sample at hand count once more, and all later ones come one place later.
    """
    out: list[tuple[int, int, str]] = []
    moving, start, still, against, late, at = None, None, 0, 0, 0, 0
    while at < len(motions):
        m = motions[at - late]
        if moving is None:
            moving = m if m != "STILL" else None
        elif m == "STILL":
            if start is None:
                start = at
            else:
                still += 1
        elif m == moving:
            start, against = None, 0
        elif start is not None:
            against += 1
            if against > 1 and still > 1:
                moving = m
                if still <= most_still:
                    out.append((start, at - against, "RIGHT" if m == "MOVINGLEFT" else "LEFT"))
                elif compat:
                    # Looked at again, this sample moves the way the camera goes now: nothing more happens.
                    late += 1
                start, still, against = None, 0, 0
        at += 1
    return out


def simple_candidates(motions: Sequence[str]) -> int:
    """How often a move, a rest and then the opposite move follow each other."""
    moving, rested, n = None, False, 0
    for m in motions:
        if m == "STILL":
            rested = moving is not None
        else:
            n += moving is not None and rested and m != moving
            moving, rested = m, False
    return n


def inherited_sides(motions: Sequence[str]) -> list[str | None]:
    """The side of each resting sample: that of the sample before if it has one; else known where moves before and after differ."""
    out: list[str | None] = []
    before = None
    coming: list[str | None] = [None] * len(motions)
    after = None
    for i in range(len(motions) - 1, -1, -1):
        coming[i] = after
        if motions[i] != "STILL":
            after = motions[i]
    for i, m in enumerate(motions):
        side = None
        if m == "STILL":
            if out and out[-1] is not None:
                side = out[-1]
            elif before is not None and coming[i] is not None and before != coming[i]:
                side = "RIGHT" if before == "MOVINGRIGHT" else "LEFT"
        else:
            before = m
        out.append(side)
    return out


def ball_entries(frame: Sequence[int], amplitude: Sequence[float], boxes: Sequence[tuple], threshold: float, run: int = 5, apart: int = 90) -> list[int]:
    """Frames above the threshold that ``run`` more follow, each of which meets the box before it, edges included."""

    def meet(a, b):
        return a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3]

    out: list[int] = []
    at = 0
    while at < len(frame):
        if amplitude[at] > threshold:
            end = at
            while end + 1 < len(frame) and amplitude[end + 1] > threshold and meet(boxes[end], boxes[end + 1]):
                end += 1
            if end - at >= run:
                if not out or frame[at] - out[-1] > apart:
                    out.append(frame[at])
                at = end
        at += 1
    return out


def match_once(detected: Sequence[int], truth: Sequence[int], tolerance: int = 105) -> tuple[int, int, int]:
    """(tp, fp, fn) of ordered transitions within a tolerance, each true one used once.

    True ones that are passed on the way to a match are missed. When none matches, the first one passed is taken
    back; with no true one left, a transition counts as false too, even right after the last match.
    """
    tp = fp = fn = g = 0
    n = len(truth)
    for d in detected:
        passed = g
        while g < n and d - truth[g] > tolerance:
            g += 1
        passed = g - passed
        if g < n and truth[g] - d <= tolerance:
            tp, fn, g = tp + 1, fn + passed, g + 1
        else:
            fn += max(0, passed - 1)
            if g < n:
                fp += 1
                g -= bool(passed)
        fp += g == n
    return tp, fp, fn + n - g


def match_segments(ends: Sequence[int], truth: Sequence[int]) -> tuple[int, int, int]:
    """(tp, fp, fn): a segment that ends before the next true marker is false, else it takes that marker.

    Segments behind the last true marker are not counted.
    """
    tp = fp = 0
    for end in ends:
        if tp < len(truth):
            if end < truth[tp]:
                fp += 1
            else:
                tp += 1
    return tp, fp, len(truth) - tp


def match_between(starts: Sequence[int], ends: Sequence[int], truth: Sequence[int]) -> tuple[int, int, int]:
    """(tp, fp, fn) of segments, each of which claims the true markers up to the end of the next one.

    The last segment is always false, and true markers that are left are not counted as missed.
    """
    tp = fp = fn = g = 0
    n = len(truth)
    for i, end in enumerate(ends):
        if g == 0 and n and starts[i] >= truth[0]:
            g = 1
        if i == len(ends) - 1 or g >= n:
            fp += 1
        elif end <= truth[g]:
            if truth[g] < ends[i + 1]:
                tp, g = tp + 1, g + 1
            else:
                fp += 1
        elif ends[i + 1] < truth[g]:
            fp += 1
        else:
            passed = 0
            while g < n and end > truth[g]:
                g, passed = g + 1, passed + 1
            fn += passed
            if g < n:
                tp, g = tp + 1, g + 1
    return tp, fp, fn


def agreement(truth: Sequence[tuple], found: Sequence[tuple]) -> tuple[float, int, int]:
    """(percent, extra, missed) of ordered (start, end, side): the mean share of a segment that a true one of its side covers.

    Each true segment is looked at once; a found one that ends before the next true one starts is extra.
    """
    g = extra = missed = 0
    total = 0.0
    for start, end, side in found:
        while g < len(truth):
            true_start, true_end, true_side = truth[g]
            if end < true_start:
                extra += 1
                break
            g += 1
            if true_end < start:
                missed += 1
            elif true_side == side:
                total += (min(true_end, end) - max(true_start, start)) / (end - start) if end > start else 0.0
                break
    counted = len(found) - extra
    return (100 * total / counted if counted else 0.0), extra, missed


def leader_clusters(nodes: Sequence[int], matched: set[tuple[int, int]]) -> dict[int, int]:
    """Cluster of each node: the first free node leads, all free nodes that match it join."""
    cluster: dict[int, int] = {}
    near: dict[int, list[int]] = {}
    for a, b in matched:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    no = 0
    for i in nodes:
        if i in cluster:
            continue
        cluster[i] = no
        for j in near.get(i, ()):
            cluster.setdefault(j, no)
        no += 1
    return cluster


def merge_clusters(histograms: dict[str, list[float]], until: int = 3, at_most: float = 1000.0) -> list[tuple[str, int]]:
    """(id, members) after the closest two clusters were merged until few are left; the merged one is their plain mean.

    Each cluster remembers the closest of those behind it; only what was closest to a merged one is sought anew.
    """
    names, members = list(histograms), [1] * len(histograms)
    n = len(names)
    if n <= max(until, 1):
        return list(zip(names, members, strict=True))
    means = np.zeros((2 * n, len(next(iter(histograms.values())))))
    means[:n] = list(histograms.values())
    alive = np.zeros(2 * n, bool)
    alive[:n] = True
    closest, where = np.full(2 * n, np.inf), np.full(2 * n, -1)

    def distances(one: int, others: np.ndarray) -> np.ndarray:
        total = np.zeros(len(others))
        for column in range(means.shape[1]):
            total += (means[others, column] - means[one, column]) ** 2
        return np.sqrt(total)

    def seek(i: int) -> None:
        behind = i + 1 + np.flatnonzero(alive[i + 1 : len(names)])
        closest[i], where[i] = np.inf, -1
        if len(behind):
            d = distances(i, behind)
            closest[i], where[i] = d.min(), behind[d.argmin()]

    for i in range(n):
        seek(i)
    for left in range(n, until, -1):
        i = int(closest.argmin())
        if left < 2 or not closest[i] < at_most:
            break
        j, new = int(where[i]), len(names)
        names.append(f"{names[i]}_{names[j]}")
        members.append(members[i] + members[j])
        means[new] = (means[i] + means[j]) / 2
        alive[[i, j]] = False
        closest[[i, j]] = np.inf
        for k in np.flatnonzero(alive & np.isin(where, (i, j))):
            seek(k)
        others = np.flatnonzero(alive)
        d = distances(new, others)
        nearer = d < closest[others]
        closest[others[nearer]], where[others[nearer]] = d[nearer], new
        alive[new] = True
    return [(names[k], members[k]) for k in np.flatnonzero(alive)]


def two_means(points: Sequence[tuple[float, float]], rounds: int = 100, eps: float = 0.001) -> tuple[list[int], list[tuple[float, float]]]:
    """Labels and centres of two clusters, started from the two points that lie furthest apart."""
    n = len(points)
    far = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    middle = (sum(p[0] for p in points) / n, sum(p[1] for p in points) / n)
    first = max(points, key=lambda p: far(p, middle))
    centres = [first, max(points, key=lambda p: far(p, first))]
    labels = [0] * n
    for _ in range(rounds):
        labels = [int(far(p, centres[1]) < far(p, centres[0])) for p in points]
        new = []
        for k in (0, 1):
            own = [p for p, label in zip(points, labels, strict=True) if label == k]
            new.append((sum(p[0] for p in own) / len(own), sum(p[1] for p in own) / len(own)) if own else centres[k])
        moved = max(far(a, b) for a, b in zip(centres, new, strict=True))
        centres = new
        if moved <= eps * eps:
            break
    return labels, centres


def track(length: int, starts: Callable[[int], bool], holds: Callable[[int], bool], interval: int = 15) -> list[tuple[int, bool]]:
    """(place, started anew) of a tracker over places 0 to ``length``.

    ``starts``: a detection is good enough to start from; it is looked for every ``interval`` places before the last
    one. ``holds``: the tracker still has its box.
    """
    out: list[tuple[int, bool]] = []
    at = 0
    while at <= length:
        if out and holds(at):
            out.append((at, False))
        else:
            while at < length and not starts(at):
                at += interval
            if at >= length:
                break
            out.append((at, True))
        at += 1
    return out
