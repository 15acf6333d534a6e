"""Packing documents into as few token sequences as possible, by best-two-fit.

Only lengths matter for the packing, and there are at most ``capacity`` different ones. So Spark counts how
many pieces have each length, the driver packs these counts (a table of bounded size), and Spark deals the
places out again by each piece's rank among the pieces of its length. Best-two-fit: a bin is filled greedily,
the longest piece that fits first; then its smallest piece gives way to two unpacked pieces where these fill
the gap more tightly. A bin found this way is used as often as the counts allow, so a packing is a list of at
most ``capacity + sum(capacity / length)`` patterns with a number of uses, whatever the number of documents.

Documents longer than the capacity, and only they, are cut into pieces of that capacity; the last may be shorter.

Edge cases: a null text is the empty text, which is the closing id alone; repeated rows are packed as separate
documents; ties are broken by the order in which rows are read; an empty table gives no pieces; columns other than
the named two are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordbpe
from .arrow import rows
from .store import store, table

CAPACITY, CLOSING_ID = 4096, 1


def best_two_fit(counts: dict[int, int], capacity: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of uses, [(length, times in a bin)] from the longest) that use up ``counts``."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    while lengths:
        used: dict[int, int] = {}
        gap, top = capacity, len(lengths)
        while (top := bisect.bisect_right(lengths, gap, 0, top)) > 0:
            n = lengths[top - 1]
            times = min(left[n], gap // n)
            used[n] = times
            gap -= times * n
            top -= 1
        if gap and len(used) + max(used.values()) > 2:
            _exchange(used, left, lengths, gap)
        uses = min(left[n] // t for n, t in used.items())
        yield uses, sorted(used.items(), reverse=True)
        for n, t in used.items():
            left[n] -= uses * t
            if not left[n]:
                del left[n]
                del lengths[bisect.bisect_left(lengths, n)]


def _exchange(used: dict[int, int], left: dict[int, int], lengths: list[int], gap: int) -> None:
    """Replace the smallest piece of a bin by two unpacked ones that fill its room further, if there are such."""
    small = min(used)
    room = gap + small
    free = np.array([n for n in lengths[: bisect.bisect_right(lengths, room)] if left[n] > used.get(n, 0) - (n == small)], dtype=np.int64)
    if not len(free):
        return
    partner = np.searchsorted(free, room - free, side="right") - 1
    ok = partner >= 0
    a, b = free[ok], free[partner[ok]]
    spare = np.array([left[int(n)] - used.get(int(n), 0) + (int(n) == small) for n in free])[ok]
    fine = (a != b) | (spare >= 2)
    total = np.where(fine, a + b, 0)
    if len(total) and total.max() > small:
        at = int(total.argmax())
        used[small] -= 1
        if not used[small]:
            del used[small]
        for n in (int(a[at]), int(b[at])):
            used[n] = used.get(n, 0) + 1


class Plan:
    """Places by length and rank: from which rank on, pieces of a length take which sequences and offsets."""

    def __init__(self, counts: dict[int, int], capacity: int):
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        self.sequences = self.patterns = 0
        for uses, pattern in best_two_fit(counts, capacity):
            offset = 0
            for n, times in pattern:
                spans.setdefault(n, []).append((taken.get(n, 0), times, self.sequences, offset))
                taken[n] = taken.get(n, 0) + uses * times
                offset += n * times
            self.sequences += uses
            self.patterns += 1
        self.spans = {n: np.array(s, dtype=np.int64).T for n, s in spans.items()}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for n in np.unique(lengths):
            own = lengths == n
            first, times, base, start = self.spans[int(n)]
            at = np.searchsorted(first, ranks[own], side="right") - 1
            within = ranks[own] - first[at]
            sequence[own] = base[at] + within // times[at]
            offset[own] = start[at] + within % times[at] * n
        return sequence, offset


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing_id: int = CLOSING_ID, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 or ids, part, turn): the pieces of each document.

    ``turn`` counts the pieces of a length within the task ``part`` that made them.
    """
    path = path or wordbpe.default_path()
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    end = np.array([closing_id], "<u4").tobytes()

    def cut(batches):
        c, part, turns = wordbpe.codec(path), TaskContext.get().partitionId(), {}
        c.clear()  # a worker's next task may be of other texts
        for batch in batches:
            for some in rows(batch, 64):
                found = []
                for doc_id, text in some:
                    ids = c.encode(text) + end
                    for no, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        turn = turns.get(n, 0)
                        turns[n] = turn + 1
                        found.append((doc_id, no, at // 4, n, own if with_ids else zlib.crc32(own), part, turn))
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary() if with_ids else pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids" if with_ids else "ids_crc32", "part", "turn"])

    return source.mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, {'ids binary' if with_ids else 'ids_crc32 long'}, part int, turn long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing_id: int = CLOSING_ID, with_ids: bool = False, path: str | None = None) -> DataFrame:
    """The pieces of ``df`` with ``sequence_id`` and ``offset``; sequences are numbered from 0 without gaps."""
    cut = store(pieces(df, id_col, text_col, capacity, closing_id, with_ids, path), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # At most `capacity` rows, whatever the input.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = df.sparkSession.sparkContext.broadcast(Plan(counts, capacity))
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", *cut.columns[4:5], (F.col("before") + F.col("turn")).alias("rank"))
    id_type = cut.schema["doc_id"].dataType.simpleString()

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                sequence, offset = plan.value.place(batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, f"doc_id {id_type}, piece int, start long, length long, {'ids binary' if with_ids else 'ids_crc32 long'}, sequence_id long, offset long")


def op4_best_two_fit(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
