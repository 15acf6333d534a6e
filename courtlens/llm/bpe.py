"""Byte-level BPE encoding and decoding by overlapping chunks.

Short texts are pre-tokenised and encoded where they are read. A long text is cut into overlapping
chunks which are pre-tokenised in parallel; neighbouring chunks are stitched at the first pre-token
boundary that both of them have in their overlap. A pre-token depends only on the text from its start
on, so from a shared boundary on both sequences agree; where an overlap has no shared boundary, the
sequence is carried on from the last sure boundary until it meets one. The stitched pieces are then
encoded in parallel. Decoding concatenates the raw bytes of the ids.

Edge cases: a null text is encoded as the empty text (no ids); repeated rows and null ids are kept as
they are, one result row for each input row; an empty table gives an empty result; columns other than the two named ones are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import rows

#: Characters of a chunk without its overlap, and of the overlap. Longer texts than a chunk are cut.
CHUNK, OVERLAP = 32_768, 512
#: Texts with a run of so many letters, digits, signs or spaces are encoded here, with a heap, in n log n steps.
LONG_RUN = 4_096


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the pair of the lowest rank first, the leftmost of equal ones."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    live = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not live[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        live[ends[i]] = 0
        ends[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


def endless(text: str) -> bool:
    """Whether the text may have a run of LONG_RUN characters without a pre-token boundary."""
    words = [*map(len, text.split())]
    return max(words, default=0) >= LONG_RUN or len(text) - sum(words) - len(words) >= LONG_RUN


class Codec:
    """Ids of texts, as little-endian unsigned 32-bit numbers, and back."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.short = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        top = max(self.ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * top
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i).encode() for i in range(top)]

    def encode(self, text: str) -> bytes:
        if len(text) < LONG_RUN or not endless(text):
            return self.short.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array([i for piece in self.split.findall(text) for i in merge(piece.encode(), self.ranks)], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def ends(self, text: str, last: bool) -> np.ndarray:
        """Where pre-tokens end that stay as they are when more text follows, unless ``last``, or when none follows.

        Two characters behind an end show that it stays. Behind white space, the end of a piece would change the split.
        """
        pieces = self.split.findall(text)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        whole = ~np.fromiter((x[-1].isspace() for x in pieces), bool, len(pieces))
        return ends[whole & (ends <= (len(text) if last else len(text) - 2))]


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def stitch(chunks: list[tuple[int, str, np.ndarray]], split, text_end: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of a text from its chunks (start, text, sure boundaries as of ``Codec.ends``), in order.

    Each piece starts and ends at a true pre-token boundary.
    """
    cuts, here = [0], 0  # here: the last true boundary
    text = None
    for (start, _, ends), (after, _, next_ends) in zip(chunks, chunks[1:], strict=False):
        sure = ends[ends >= max(here, after)] if here == start or here in ends else ends[:0]
        shared = np.intersect1d(sure, np.concatenate([[after], next_ends]))
        if len(shared):
            here = int(shared[0])
            cuts.append(here)
            continue
        # No shared boundary: carry on from the last true one until the next chunk's sequence is met.
        if text is None:
            text = "".join(t[: chunks[i + 1][0] - s] if i + 1 < len(chunks) else t for i, (s, t, _) in enumerate(chunks))
        known = {after, *next_ends.tolist()}
        for m in split.finditer(text, here):
            if m.end() >= after and m.end() in known and not m.group()[-1].isspace():
                here = m.end()
                cuts.append(here)
                break
    cuts = sorted({*cuts, text_end})
    return list(zip(cuts, cuts[1:], strict=False))


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row for each row of ``df``: the id and ``ids``, binary, little-endian unsigned 32-bit."""
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        c = codec(path, pattern)
        for batch in batches:
            for some in rows(batch):
                ids, texts = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(map(c.encode, texts), pa.binary())], ["doc_id", "ids"])

    short = source.where(F.length("text") <= chunk).mapInArrow(whole, f"doc_id {id_type}, ids binary")
    return short.unionByName(_encode_long(source.where(F.length("text") > chunk), id_type, path, pattern, chunk, overlap))


def _encode_long(source: DataFrame, id_type: str, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            for some in rows(batch, 1):
                for key, doc_id, text in some:
                    for no, at in enumerate(range(0, len(text), chunk)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key], pa.int64()), pa.array([doc_id], batch.schema.field(1).type), pa.array([no], pa.int32()), pa.array([at], pa.int64()), pa.array([text[at : at + chunk + overlap]]), pa.array([at + chunk + overlap >= len(text)])],
                            ["key", "doc_id", "no", "start", "text", "last"],
                        )

    def pretokenise(batches):
        c = codec(path, pattern)
        for batch in batches:
            for some in rows(batch, 16):
                bounds = []
                for _, _, _, start, text, last in some:
                    bounds.append((c.ends(text, last) + start).astype("<i8").tobytes())
                cols = list(zip(*some, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(v, f.type) for v, f in zip(cols, batch.schema, strict=True)), pa.array(bounds, pa.binary())], [*batch.schema.names, "bounds"])

    def stitched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        chunks = [(s, t, np.frombuffer(b, "<i8")) for s, t, b in zip(pdf["start"], pdf["text"], pdf["bounds"], strict=True)]
        text = "".join(t[:chunk] for _, t, _ in chunks[:-1]) + chunks[-1][1]
        pieces = stitch(chunks, codec(path, pattern).split, len(text))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "doc_id": pdf["doc_id"].iloc[0], "no": np.arange(len(pieces), dtype="int32"), "text": [text[a:b] for a, b in pieces]})

    def encoded(batches):
        c = codec(path, pattern)
        for batch in batches:
            for some in rows(batch, 16):
                key, doc_id, no, text = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc_id, batch.schema.field(1).type), pa.array(no, pa.int32()), pa.array(map(c.encode, text), pa.binary())], ["key", "doc_id", "no", "ids"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "ids": [b"".join(pdf["ids"])]})

    chunks = source.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(cut, f"key long, doc_id {id_type}, no int, start long, text string, last boolean")
    bounded = chunks.repartition("key", "no").mapInArrow(pretokenise, f"key long, doc_id {id_type}, no int, start long, text string, last boolean, bounds binary")
    pieces = bounded.groupBy("key").applyInPandas(stitched, f"key long, doc_id {id_type}, no int, text string")
    ids = pieces.repartition("key", "no").mapInArrow(encoded, f"key long, doc_id {id_type}, no int, ids binary")
    return ids.groupBy("key").applyInPandas(joined, f"doc_id {id_type}, ids binary")


def decode(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """Rows of :func:`encode` with ``decoded``, the concatenated raw bytes of their ids.

    With ``digests``, the ids and bytes themselves give way to ``n_tokens``, ``ids_sha256`` (decimal ids joined by
    commas) and ``decoded_sha256``.
    """
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for some in rows(batch):
                doc_id, ids = zip(*some, strict=True)
                out = [pa.array(doc_id, batch.schema.field(0).type)]
                if not digests:
                    yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])
                    continue
                found = []
                for x in ids:
                    numbers = np.frombuffer(x, "<u4").tolist()
                    found.append((len(numbers), hashlib.sha256(b",".join(map(c.decimal.__getitem__, numbers))).hexdigest(), hashlib.sha256(b"".join(map(c.bytes_of.__getitem__, numbers))).hexdigest()))
                n, a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary"
    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, {kept}")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return decode(encode(table(spark, sf_dir, "documents")), digests=True)
