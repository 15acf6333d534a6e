"""Exact dedup with a log-structured merge index over digests of normalised texts.

Each task puts the rows it reads into a memtable. A full memtable becomes a run that is sorted by digest and
has a Bloom filter; a new row first asks memtable and runs for its digest, and a hit counts only after its
bytes were compared. When a task holds too many runs they are compacted, and what is left of them, one row
for each text that the task has seen, goes to the shard of its digest. There the sorted runs of all tasks are
compacted the same way: the row with the most code points, then the smallest identifier, stays.

A hot group therefore reaches its shard as one row a run, whatever its size, and memory is bounded by the
memtable and the number of runs. Equal digests with different bytes stay apart as variants.

Edge cases: a null text is the empty text; a null identifier sorts behind all others; rows that repeat both
identifier and size of the row that stays are marked as kept like it, but ``deduplicate`` keeps one of them; an empty table gives an empty index;
columns other than the named two are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import rows
from .store import store, table

#: Characters that normalisation deletes: blank, and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
MEMTABLE_BYTES, MOST_RUNS = 4 << 20, 8
BITS_A_KEY = 10


class Bloom:
    def __init__(self, keys: list[str]):
        self.size = max(64, BITS_A_KEY * len(keys))
        self.bits = bytearray(-(-self.size // 8))
        for k in keys:
            for at in self._places(k):
                self.bits[at >> 3] |= 1 << (at & 7)

    def _places(self, key: str) -> Iterator[int]:
        h = hash(key)
        a, b = h & 0xFFFFFFFF, (h >> 32) | 1
        return ((a + i * b) % self.size for i in range(5))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._places(key))


class Entry:
    """One text: the best (code points, identifier) so far, how many rows have it, how many are as good, and its bytes."""

    __slots__ = ("size", "key", "count", "ties", "data")

    def __init__(self, size, key, count, data, ties=1):
        self.size, self.key, self.count, self.ties, self.data = size, key, count, ties, data

    def rank(self):
        return (-self.size, self.key is None, self.key)

    def take(self, other: Entry) -> None:
        self.count += other.count
        if other.rank() == self.rank():
            self.ties += other.ties
        elif other.rank() < self.rank():
            self.size, self.key, self.ties = other.size, other.key, other.ties


def settle(variants: list[Entry], new: Entry) -> bool:
    """Add ``new`` to the variant with the same bytes. False: there was none, it became another variant."""
    for v in variants:
        if v.data == new.data:
            v.take(new)
            return True
    variants.append(new)
    return False


class Run:
    def __init__(self, table: dict[str, list[Entry]]):
        self.digests = sorted(table)
        self.entries = [table[d] for d in self.digests]
        self.filter = Bloom(self.digests)

    def get(self, digest: str) -> list[Entry] | None:
        if digest not in self.filter:
            return None
        at = bisect.bisect_left(self.digests, digest)
        return self.entries[at] if at < len(self.digests) and self.digests[at] == digest else None


class MergeIndex:
    def __init__(self, memtable_bytes: int = MEMTABLE_BYTES, most_runs: int = MOST_RUNS):
        self.limit, self.most_runs = memtable_bytes, most_runs
        self.table: dict[str, list[Entry]] = {}
        self.runs: list[Run] = []
        self.bytes = 0

    def put(self, digest: str, entry: Entry) -> Iterator[tuple[str, Entry]]:
        """Take one row in; what compaction sends away comes back."""
        variants = self.table.get(digest)
        if variants is None:
            variants = next((v for run in reversed(self.runs) if (v := run.get(digest)) is not None), None)
        if variants is None:
            self.table[digest] = [entry]
            self.bytes += len(entry.data) + 200
        elif not settle(variants, entry):
            self.bytes += len(entry.data)
        if self.bytes >= self.limit:
            self.flush()
            if len(self.runs) >= self.most_runs:
                yield from self.compact()

    def flush(self) -> None:
        if self.table:
            self.runs.append(Run(self.table))
        self.table, self.bytes = {}, 0

    def compact(self) -> Iterator[tuple[str, Entry]]:
        """All runs as one run in the order of its digests; they leave the index."""
        self.flush()
        runs, self.runs = self.runs, []
        for digest, variants in heapq.merge(*(zip(r.digests, r.entries, strict=True) for r in runs), key=lambda x: x[0]):
            for entry in variants:
                yield digest, entry


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _batches(found: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), types, strict=True)], names)

    for row in found:
        held.append(row)
        size += 100 + len(row[-1] or b"")
        if size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256), memtable_bytes: int = MEMTABLE_BYTES, most_runs: int = MOST_RUNS) -> DataFrame:
    """(digest, variant, keep_id, keep_size, group_size, ties, data): one row for each different normalised text.

    ``ties`` is the number of rows with the identifier and size that stay, 1 unless rows repeat them; ``data`` holds the bytes only where several texts share a digest.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    norm = normalised(F.col(text_col))
    source = df.select(digest(norm).alias("digest"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("size"), F.col(id_col).alias("key"), norm.cast("binary").alias("data"))

    def memtables(batches):
        index, key_type = MergeIndex(memtable_bytes, most_runs), None

        def found():
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field(2).type
                for some in rows(batch):
                    for d, size, key, data in some:
                        for x, e in index.put(d, Entry(size, key, 1, data)):
                            yield x, e.size, e.key, e.count, e.ties, e.data
            for x, e in index.compact():
                yield x, e.size, e.key, e.count, e.ties, e.data

        first = next(it := found(), None)
        if first is not None:
            yield from _batches(_chain(first, it), ["digest", "size", "key", "count", "ties", "data"], [pa.string(), pa.int64(), key_type, pa.int64(), pa.int64(), pa.binary()])

    def shard(batches):
        key_type = None

        def found():
            nonlocal key_type
            at, variants = None, []

            def out():
                for no, v in enumerate(sorted(variants, key=Entry.rank)):
                    yield at, no, v.key, v.size, v.count, v.ties, v.data if len(variants) > 1 else None

            for batch in batches:
                key_type = batch.schema.field(2).type
                for some in rows(batch):
                    for d, size, key, count, ties, data in some:
                        if d != at:
                            yield from out()
                            at, variants = d, []
                        settle(variants, Entry(size, key, count, data, ties))
            yield from out()

        first = next(it := found(), None)
        if first is not None:
            yield from _batches(_chain(first, it), ["digest", "variant", "keep_id", "keep_size", "group_size", "ties", "data"], [pa.string(), pa.int32(), key_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    runs = source.mapInArrow(memtables, f"digest string, size long, key {id_type}, count long, ties long, data binary")
    return runs.repartition("digest").sortWithinPartitions("digest").mapInArrow(shard, f"digest string, variant int, keep_id {id_type}, keep_size long, group_size long, ties long, data binary")


def _chain(first, rest):
    yield first
    yield from rest


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256), **index) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for each row of ``df``."""
    norm = normalised(F.col(text_col))
    light = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("size"), digest(norm).alias("digest"), norm.cast("binary").alias("own"))
    index = store(build_index(df, id_col, text_col, digest, **index), "lsm")
    clash = index.where("variant > 0").select("digest").distinct()
    if clash.isEmpty():
        joined = light.drop("own").join(index, "digest")
    else:
        one = light.drop("own").join(clash, "digest", "left_anti").join(index, "digest")
        several = light.join(clash, "digest", "left_semi").join(index.withColumnRenamed("data", "own"), ["digest", "own"]).drop("own").withColumn("data", F.lit(None).cast("binary"))
        joined = one.unionByName(several)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size"))).alias("kept"), "digest")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256), **index) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: exactly one for each different normalised text."""
    found = store(build_index(df, id_col, text_col, digest, **index), "lsm")
    hashed = df.withColumns({"_courtlens_digest_of_text": digest(normalised(F.col(text_col))), "_courtlens_size_of_text": F.coalesce(F.length(text_col), F.lit(0))})

    def same(of: DataFrame):
        norm = normalised(F.col(text_col)).cast("binary")
        return F.col(id_col).eqNullSafe(of["_courtlens_id"]) & (F.col("_courtlens_digest_of_text") == of["_courtlens_digest"]) & (F.col("_courtlens_size_of_text") == of["_courtlens_size"]) & (of["_courtlens_data"].isNull() | (of["_courtlens_data"] == norm))

    stay = found.select(F.col("keep_id").alias("_courtlens_id"), F.col("digest").alias("_courtlens_digest"), F.col("keep_size").alias("_courtlens_size"), F.col("data").alias("_courtlens_data"), "ties")
    kept = hashed.join(stay.drop("ties"), same(stay), "left_semi")
    again = stay.where("ties > 1").drop("ties")
    if not again.isEmpty():  # rows that repeat both identifier and text: of those, one stays
        one = kept.join(again, same(again), "left_semi").withColumn("_courtlens_text_of_row", normalised(F.col(text_col))).dropDuplicates([id_col, "_courtlens_text_of_row"]).drop("_courtlens_text_of_row")
        kept = kept.join(again, same(again), "left_anti").unionByName(one)
    return kept.drop("_courtlens_digest_of_text", "_courtlens_size_of_text")


def op2_lsm_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
