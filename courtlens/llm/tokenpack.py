"""Token ids as packed binary matrices: best-fit-decreasing with a segment tree over free room.

Each task encodes the texts it reads and packs them in lots of bounded size, so nothing is shuffled and memory
does not grow with the input. Texts longer than a row are split without loss into full rows and a rest. A lot's
pieces are placed from the longest on, each into the row with the least room that still holds it; a segment tree
over the amounts of free room finds that room in log steps.

A row has its ids (little-endian, padded with ``pad_id``), the cumulative lengths of its segments as
attention kernels take them, the position at which each segment starts (0 for a document's first piece, else the
piece's place in its document), and the documents the segments belong to.

Edge cases: a null or empty text has no ids and takes no place; repeated rows are packed as separate documents;
an empty table gives no rows; columns other than the named two are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import rows
from .bpe import codec, default_pattern
from .store import table

ROW, LOT_TOKENS = 2048, 4 << 20


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Rooms:
    """How many open rows have each amount of free room, in a segment tree of counts."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room that is at least ``least``, as (room, row)."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at ^ 1]):
                at >>= 1
            if at <= 1:
                return None
            at ^= 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[list[int]], int]:
    """Rows as lists of indices into ``lengths``, each in the order of placing, and the number of rows."""
    rooms, out = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        found = rooms.take(n)
        if found is None:
            out.append([i])
            room, row = capacity, len(out) - 1
        else:
            room, row = found
            out[row].append(i)
        if room > n:
            rooms.put(room - n, row)
    return out, len(out)


def pack_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, lot_tokens: int = LOT_TOKENS, ranks_path: str | None = None, pattern: str | None = None, pad_id: int | None = None) -> DataFrame:
    """(part, row, n_tokens, doc_ids, starts, cu_seqlens, ids): one row for each packed row.

    ``pad_id`` is by default the first id behind the vocabulary, so no token is taken for padding.
    """
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    names = ["part", "row", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids"]

    def run(batches):
        c, part, done = codec(path, pattern), TaskContext.get().partitionId(), 0
        pad = len(c.bytes_of) if pad_id is None else pad_id
        wide = "<u2" if max(len(c.bytes_of) - 1, pad) < 1 << 16 else "<u4"
        pieces: list[tuple] = []
        held = 0

        def settled(id_pa) -> Iterator[pa.RecordBatch]:
            nonlocal done, held
            packed, _ = best_fit_decreasing([len(p[2]) for p in pieces], row)
            for low in range(0, len(packed), 512):
                out = []
                for members in packed[low : low + 512]:
                    own = [pieces[i] for i in members]
                    ids = np.full(row, pad, wide)
                    ends = np.cumsum([0, *(len(p[2]) for p in own)])
                    ids[: ends[-1]] = np.concatenate([p[2] for p in own])
                    out.append((part, done, int(ends[-1]), [p[0] for p in own], [p[1] for p in own], ends.tolist(), ids.tobytes()))
                    done += 1
                types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(id_pa), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)
            pieces.clear()
            held = 0

        id_pa = None
        for batch in batches:
            id_pa = batch.schema.field(0).type
            for some in rows(batch):
                for doc_id, text in some:
                    ids = np.frombuffer(c.encode(text), "<u4").astype(wide)
                    pieces += [(doc_id, at, ids[at : at + row]) for at in range(0, len(ids), row)]
                    held += len(ids)
                    if held >= lot_tokens:
                        yield from settled(id_pa)
        if pieces:
            yield from settled(id_pa)

    return source.mapInArrow(run, f"part int, row long, n_tokens int, doc_ids array<{id_type}>, starts array<long>, cu_seqlens array<int>, ids binary")


def write_rows(packed: DataFrame, path: str) -> None:
    """Write packed rows as a table of binary id rows, with cumulative lengths and where positions start over.

    In Parquet, by the executors: a reader stacks ``ids`` of equal length to a matrix without parsing.
    """
    packed.write.parquet(path)


def matrix(ids: list[bytes], row: int = ROW) -> np.ndarray:
    """The id matrix of some written rows."""
    wide = "<u2" if ids and len(ids[0]) == 2 * row else "<u4"
    return np.frombuffer(b"".join(ids), wide).reshape(-1, row)


def position_ids(starts: list[int], cu_seqlens: list[int], row: int = ROW) -> np.ndarray:
    """The position of each token of a packed row, reset where a segment starts; 0 in the padding."""
    out = np.zeros(row, np.int64)
    for s, a, b in zip(starts, cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(s, s + b - a)
    return out


def op7_token_rows(spark, sf_dir: str) -> DataFrame:
    return pack_rows(table(spark, sf_dir, "documents"))
