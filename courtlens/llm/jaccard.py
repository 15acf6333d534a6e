"""N-gram Jaccard join by vertical partitioning of a global order of shingles.

The global order puts rare shingles first. A shingle is no more frequent than its words, so it is ranked by how often
its words occur, after a check that the shingle itself is not common; both come from counts by hash that are made over
all documents. Ties go by hash. Any order gives right results, a good one few candidates.

1. Documents with equal sets form a class, which is named by a digest of its set.
2. Two sets of Jaccard similarity t or more share one of the first ``n - ceil(t n) + 1`` shingles of the order.
   Each class is listed under those, in one exchange that also drops the lists of one class.
3. Short lists give all their pairs that sizes and places in the order allow. In long ones, a class is only held
   against the leaders of its list, classes that no earlier leader may be similar to by size, place and parity
   bitmap; very long lists are split into blocks for this. Distinct pairs are then held against whole bitmaps.
4. Candidates are verified by vertical partitioning: the global order is cut into fragments at places that hold about
   equally many shingles, each class sends each fragment of its set by itself, pairs meet a fragment at a time, and the
   overlaps of the fragments are summed for each pair.
5. Verified pairs are links; connected classes form components. Long lists that still hold several components are
   taken again, now with all pairs of classes from different components that no bound rules out, so no
   connection between different texts is lost. A pair within one component needs no further look.

Memory is bounded by a block of a list; no pair within a group of copies is made, and neither sets nor links
ever reach the driver.

Edge cases: a null text or one without words has the empty set and is linked with nothing; a text with fewer
words than a shingle is one shingle, its whole sequence; repeated rows are equal sets; null identifiers form no
links and are their own component (null); an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import made, rows
from .graph import components
from .shingles import runs, words
from .store import discard, store, table

#: Counters for words, and as many for shingles.
CELLS = 1 << 21
#: Steps of the order for one doubling of the product of word counts, and the highest level that words give.
STEPS, LEVELS = 1, 128
#: Classes of a list that are held against each other in one piece of work.
BLOCK = 2048
#: Lists of so many classes or fewer give all their pairs.
SMALL = 12
FRAGMENTS = 8
#: Shares of a list's rows, for joins with what is known of the list.
SALTS = 16
#: Most cells of a parity bitmap that goes with each row of a long list, and the bits of the table that tells which documents verification reads.
MOST_CELLS, WANTED = 1024, 1 << 24
_HASH_BITS = 52


def need(n, num: int, den: int):
    """The least size of a set that a set of n can be similar to, which is also the least overlap: ceil(t n)."""
    return -(-n * num // den)


def most_apart(total, num: int, den: int):
    """The largest symmetric difference of two similar sets whose sizes sum to ``total``."""
    return total - 2 * (-(-total * num // (num + den)))


def bitmap(found: np.ndarray, num: int, den: int) -> bytes:
    """One bit of parity for each cell that shingles fall into, four cells for each allowed difference.

    Two bitmaps differ in no more bits than their sets do in shingles, whatever the number of cells.
    """
    bits = 64
    wanted = 4 * most_apart(2 * len(found), num, den)
    while bits < wanted:
        bits *= 2
    cells = np.bincount((found >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> bytes:
    """A bitmap with so many bytes or fewer."""
    while len(raw) > size:
        half = len(raw) // 2
        raw = (int.from_bytes(raw[:half], "little") ^ int.from_bytes(raw[half:], "little")).to_bytes(half, "little")
    return raw


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, folded to the smaller one's size."""
    size = min(len(x), len(y))
    return (int.from_bytes(folded(x, size), "little") ^ int.from_bytes(folded(y, size), "little")).bit_count()


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def _shingled(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds of rows in them, shingle hashes by first word) of some rows at a time."""
    for low, h, bounds in words(column):
        yield low, h, bounds, runs(h, width)


# --- the order --------------------------------------------------------------------------------------------------


def _counted(source: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How common each cell of words is (log2 of its count), and how far each cell of shingles is above the mean."""

    def run(batches):
        sums = [np.zeros(CELLS, np.uint32), np.zeros(CELLS, np.uint32)]
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def settle():
            for s, parts in zip(sums, held, strict=True):
                if parts:
                    s += np.bincount(np.concatenate(parts), minlength=CELLS).astype(np.uint32)
                    parts.clear()

        for batch in batches:
            for _, h, bounds, shingles in _shingled(batch.column("text"), width):
                held[0].append(_cell(h).astype(np.int32))
                # Runs that go over the end of a text are counted too: any order will do.
                held[1].append(_cell(shingles).astype(np.int32))
                size += len(h)
                if size >= CELLS:
                    settle()
                    size = 0
        settle()
        for kind, s in enumerate(sums):
            if s.any():
                planes = s.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([zlib.compress(planes.tobytes(), 1)], pa.binary())], ["kind", "counts"])

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for ((kind, counts),) in rows(batch, 1):
                own = np.frombuffer(zlib.decompress(counts), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                sums[kind] = sums[kind] + own if kind in sums else own.astype(np.uint64)
        for kind, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([zlib.compress(s.astype("<u8").tobytes(), 1)], pa.binary())], ["kind", "counts"])

    # Two arrays a task, then sums of them in a tree: what comes to the driver is a few arrays of CELLS, whatever the input.
    each = source.select("text").mapInArrow(run, "kind int, counts binary")
    some = each.repartition(16).mapInArrow(summed, "kind int, counts binary")
    counts = [np.zeros(CELLS, np.uint64), np.zeros(CELLS, np.uint64)]
    for r in some.toLocalIterator():
        counts[r["kind"]] += np.frombuffer(zlib.decompress(r["counts"]), "<u8")
    common = np.minimum(np.round(np.log2(counts[0].astype(np.float64) + 1) * 4), 255).astype(np.uint8)
    mean = max(1.0, counts[1].mean())
    above = np.clip(np.floor(np.log2(np.maximum(counts[1], 1) / mean)), 0, 30).astype(np.uint8)
    return common, above


def ordered(h: np.ndarray, shingles: np.ndarray, common: np.ndarray, above: np.ndarray, width: int) -> np.ndarray:
    """The places of ``shingles`` in the global order as numbers: how common by itself, by its words, then hash."""
    k, n = len(shingles), len(h)
    of_words = common[_cell(h)].astype(np.int64)
    total = np.zeros(k, np.int64)
    for i in range(min(width, n)):
        total += of_words[i : i + k]
    level = np.minimum(total * STEPS // 4, LEVELS - 1)
    return ((above[_cell(shingles)].astype(np.int64) * LEVELS + level).astype(np.uint64) << np.uint64(_HASH_BITS)) | (shingles >> np.uint64(64 - _HASH_BITS))


def _sets(column: pa.Array, order, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, places in the order, hashes): the different shingles of each row that has a word, in the global order."""
    common, above = order
    for low, h, bounds, shingles in _shingled(column, width):
        places = ordered(h, shingles, common, above, width)
        for i in range(len(bounds) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= width:
                own, at = shingles[a : b - width + 1], places[a : b - width + 1]
                by = np.argsort(at)
                own, at = own[by], at[by]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
                yield low + i, at[fresh], own[fresh]
            elif b > a:
                own = runs(h[a:b], b - a)
                yield low + i, ordered(h[a:b], own, common, above, b - a), own


# --- classes and their lists ------------------------------------------------------------------------------------


def _profiles(source: DataFrame, id_type: str, order, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, th, n, sig, bits, tokens) of each document, and rows (levels, counts) of each task for the fragments.

    ``tokens`` are the shingles that a set is listed under; a task gives bitmap and tokens of a set once.
    """
    names = ["doc_id", "th", "n", "sig", "bits", "tokens", "levels", "counts"]
    rest = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches):
        seen: set[bytes] = set()
        levels = np.zeros(32 * LEVELS, np.int64)
        id_pa = None
        for batch in batches:
            id_pa = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, hashes = part.column("doc_id").to_pylist(), part.column("th").to_pylist()
                out = [(d, t, 0, None, None, None, None, None) for d, t in zip(ids, hashes, strict=True)]
                for row, places, own in _sets(part.column("text"), order.value, width):
                    n, sig = len(own), xxhash.xxh3_128_digest(own.tobytes())
                    bits = tokens = None
                    if ids[row] is not None and sig not in seen:
                        seen.add(sig)
                        bits = bitmap(own, num, den)
                        tokens = places[: n - need(n, num, den) + 1].view(np.int64)
                        np.add.at(levels, (places >> np.uint64(_HASH_BITS)).astype(np.int64), 1)
                    out[row] = (ids[row], hashes[row], n, sig, bits, tokens, None, None)
                yield made(out, names, [id_pa, *rest])
        if levels.any():
            where = np.flatnonzero(levels)
            yield made([(None, None, None, None, None, None, where.astype(np.int32), levels[where])], names, [id_pa, *rest])

    return source.mapInArrow(run, f"doc_id {id_type}, th long, n long, sig binary, bits binary, tokens array<long>, levels array<int>, counts array<long>")


def _pivots(profiles: DataFrame) -> np.ndarray:
    """The levels at which fragments of the order start, but for the first: each holds about equally many shingles."""
    each = profiles.where("levels is not null").select(F.explode(F.arrays_zip("levels", "counts")).alias("x")).select("x.levels", "x.counts")
    found = sorted(each.groupBy("levels").agg(F.sum("counts").alias("n")).collect())  # 32 * LEVELS rows at most
    sums = np.cumsum([r["n"] for r in found]) if found else np.zeros(0)
    return np.array([found[int(np.searchsorted(sums, sums[-1] * f / FRAGMENTS))]["levels"] for f in range(1, FRAGMENTS)] if found else [], np.uint64)


def _short_lists(postings: DataFrame, num: int, den: int) -> DataFrame:
    """From rows (token, sig, n, pos): pairs (a, b) of the short lists, and the rows (token, a, n, pos, block) of long ones.

    Rows come sorted by token and sig. A list that goes on over a batch is carried along until it is long; the rows of
    long lists are numbered off in blocks of BLOCK.
    """

    def run(batches):
        carry = None
        long_token, long_rows = None, 0

        def of(token, n, pos):
            """Pairs of short lists, as places of rows, and the rows of long lists."""
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sizes = np.diff(np.append(starts, len(token)))
            pairs = []
            for k in range(2, SMALL + 1):
                own = starts[sizes == k]
                if len(own):
                    i, j = np.triu_indices(k, 1)
                    a, b = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
                    least = -(-(n[a] + n[b]) * num // (num + den))
                    fits = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least
                    pairs.append(np.stack([a[fits], b[fits]]))
            long_ = np.flatnonzero(np.repeat(sizes > SMALL, sizes))
            return np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64), long_, (long_ - np.repeat(starts, sizes)[long_]) // BLOCK

        def sent(sigs, token, n, pos, pairs, long_, block):
            if pairs.shape[1]:
                a, b = sigs.take(pa.array(pairs[0])), sigs.take(pa.array(pairs[1]))
                k = len(a)
                yield pa.RecordBatch.from_arrays([a, b, *[pa.nulls(k, pa.int64())] * 4], ["a", "b", "token", "n", "pos", "block"])
            if len(long_):
                yield pa.RecordBatch.from_arrays([sigs.take(pa.array(long_)), pa.nulls(len(long_), pa.binary()), pa.array(token[long_]), pa.array(n[long_]), pa.array(pos[long_]), pa.array(block)], ["a", "b", "token", "n", "pos", "block"])

        def settled(batch, last):
            """Pairs and rows of the lists that are whole; the rows of the last list are carried unless it is over."""
            nonlocal carry, long_token, long_rows
            if batch.num_rows:
                sigs = batch.column("sig").cast(pa.binary(16))
                token = batch.column("token").to_numpy()
                raw = np.frombuffer(sigs.buffers()[1], np.uint64, 2 * (sigs.offset + len(sigs))).reshape(-1, 2)[sigs.offset :]
                # The digests of equal sets lie next to each other.
                fresh = np.ones(len(token), bool)
                fresh[1:] = (token[1:] != token[:-1]) | (raw[1:] != raw[:-1]).any(axis=1)
                if not fresh.all():
                    batch = batch.filter(pa.array(fresh))
                    token = batch.column("token").to_numpy()
                sigs, n, pos = batch.column("sig"), batch.column("n").to_numpy(), batch.column("pos").to_numpy()
                if long_token is not None:
                    k = int(np.searchsorted(token != long_token, True))
                    yield from sent(sigs, token, n, pos, np.empty((2, 0), np.int64), np.arange(k), (long_rows + np.arange(k)) // BLOCK)
                    long_rows += k
                    batch = batch.slice(k)
                    if not batch.num_rows:  # the next batch may start with the last digest again; the list's reader drops it
                        carry = None
                        return
                    long_token = None
                    token, sigs, n, pos = token[k:], sigs.slice(k), n[k:], pos[k:]
                end = len(token) if last else int(np.searchsorted(token == token[-1], True))
                if not last and len(token) - end > SMALL:
                    long_token, long_rows, end = token[-1], len(token) - end, len(token)
                if end:
                    yield from sent(sigs, token, n, pos, *of(token[:end], n, pos))
                carry = batch.slice(end)

        for batch in batches:
            if batch.num_rows:
                if carry is not None and carry.num_rows:
                    batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
                yield from settled(batch, False)
        if carry is not None and carry.num_rows:
            yield from settled(carry, True)

    dealt = postings.repartition("token").sortWithinPartitions("token", "sig")
    return dealt.mapInArrow(run, "a binary, b binary, token long, n long, pos long, block long")


class _List:
    """Classes of one list as arrays; ``may(i, j)`` tells which of ``j`` may be similar to ``i``."""

    def __init__(self, members: list[tuple], num: int, den: int):
        self.id = [m[0] for m in members]
        self.n = np.array([m[1] for m in members], np.int64)
        self.pos = np.array([m[2] for m in members], np.int64)
        self.part = [m[4] for m in members]
        self.num, self.den = num, den
        bits = min(min(len(m[3]) for m in members), MOST_CELLS // 8)
        self.bits = np.stack([np.frombuffer(folded(m[3], bits), np.uint64) for m in members])

    def may(self, i: int, j: np.ndarray) -> np.ndarray:
        total = self.n[i] + self.n[j]
        least = -(-total * self.num // (self.num + self.den))
        fits = np.minimum(self.n[i] - self.pos[i], self.n[j] - self.pos[j]) >= least
        j, total, least = j[fits], total[fits], least[fits]
        apart = np.bitwise_count(self.bits[j] ^ self.bits[i]).sum(axis=1)
        return j[apart <= total - 2 * least]


def _pairs(lists: DataFrame, num: int, den: int, leaders: bool) -> DataFrame:
    """Candidate pairs (a, b) of the lists (token, block, sig, n, pos, bits, part, side).

    With ``leaders``, a class is held against the leaders before it only, and a row with a ``token`` in place of a
    pair names each list in which pairs were left out. Else pairs of different parts are made, all of them.
    """

    def of(token: int, members: list[tuple]) -> Iterator[tuple]:
        members = sorted({m[0]: m for m in members}.values(), key=lambda m: (m[2], m[0]))
        own = _List(members, num, den)
        if leaders:
            heads = np.empty(0, np.int64)
            for i in range(len(members)):
                near = own.may(i, heads) if len(heads) else heads
                yield from ((own.id[i], own.id[j], None) for j in near)
                if not len(near):
                    heads = np.append(heads, i)
            if len(heads) < len(members):
                yield None, None, token
            return
        names = {p: k for k, p in enumerate({p[0] for p in own.part})}
        part, side = np.array([names[p[0]] for p in own.part]), np.array([p[1] for p in own.part])
        for i in range(1, len(members)):
            j = np.arange(i)
            j = j[(part[:i] != part[i]) & ((side[:i] != side[i]) | (side[i] == 2))]
            if len(j):
                yield from ((own.id[i], own.id[k], None) for k in own.may(i, j))

    def run(batches):
        key, members, out = None, [], {}

        def flushed():
            found = [(a, b, t) if a is None or a < b else (b, a, t) for a, b, t in out]
            out.clear()
            return made(found, ["a", "b", "token"], [pa.binary(), pa.binary(), pa.int64()])

        def ended():
            if len(members) > 1:
                for pair in of(key[0], members):
                    out[pair] = None
                    if len(out) >= 20_000:
                        yield flushed()

        for batch in batches:
            for some in rows(batch, 1024):
                for token, block, *m in some:
                    if (token, block) != key:
                        yield from ended()
                        key, members = (token, block), []
                    members.append((m[0], m[1], m[2], m[3], (m[4], m[5])))
        yield from ended()
        if out:
            yield flushed()

    dealt = lists.select("token", "block", "sig", "n", "pos", "bits", "part", "side").repartition("token", "block").sortWithinPartitions("token", "block")
    return dealt.mapInArrow(run, "a binary, b binary, token long")


def _narrowed(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The distinct pairs without those whose sizes or whole bitmaps differ too much."""

    def run(batches):
        for batch in batches:
            for some in rows(batch, 1024):
                kept = [(a, b) for a, b, na, nb, wa, wb in some if differing(wa, wb) <= most_apart(na + nb, num, den)]
                if kept:
                    yield made(kept, ["a", "b"], [pa.binary(), pa.binary()])

    of = lambda c: classes.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"w{c}"))
    met = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    return met.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a binary, b binary")


# --- verification -----------------------------------------------------------------------------------------------


def _wanted(places: DataFrame) -> np.ndarray:
    """WANTED bits, set where an identifier's hash falls. At most WANTED / 64 rows come to the driver."""
    bits = places.selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, CAST(place % 64 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(WANTED // 64, np.int64)
    for r in bits.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _fragments(source: DataFrame, wanted, order, pivots: np.ndarray, width: int) -> DataFrame:
    """(sig, fragment, hashes): what some documents have in each fragment of the order, as sorted 64-bit numbers.

    A table of bits, broadcast, passes over most documents that do not stand for a class with a candidate.
    """

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            place = batch.column("place").to_numpy(zero_copy_only=False)
            hit = (wanted.value[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            left = batch.filter(pa.array(hit.astype(bool)))
            out, size = [], 0
            for _, places, own in _sets(left.column("text"), order.value, width) if left.num_rows else ():
                sig = xxhash.xxh3_128_digest(own.tobytes())
                if sig in seen:
                    continue
                seen.add(sig)
                cuts = [0, *np.searchsorted(places >> np.uint64(_HASH_BITS), pivots), len(own)]
                for f, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if b > a:
                        out.append((sig, f, np.sort(own[a:b]).tobytes()))
                size += len(own)
                if size >= 1 << 18:
                    yield made(out, ["sig", "fragment", "hashes"], [pa.binary(), pa.int32(), pa.binary()])
                    out, size = [], 0
            if out:
                yield made(out, ["sig", "fragment", "hashes"], [pa.binary(), pa.int32(), pa.binary()])

    return source.select("text", F.pmod(F.xxhash64("doc_id", "th"), F.lit(WANTED)).alias("place")).mapInArrow(run, "sig binary, fragment int, hashes binary")


def _overlap(met: DataFrame) -> DataFrame:
    """(a, b, fragment, part): the overlap of two sets within one fragment."""

    def run(batches):
        for batch in batches:
            for some in rows(batch, 512):
                out = [(a, b, f, len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))) for a, b, f, x, y in some]
                yield made(out, ["a", "b", "fragment", "part"], [pa.binary(), pa.binary(), pa.int32(), pa.int64()])

    return met.select("a", "b", "fragment", "ha", "hb").mapInArrow(run, "a binary, b binary, fragment int, part long")


def _verified(pairs: DataFrame, source: DataFrame, classes: DataFrame, order, pivots: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar, as overlaps of single fragments say that are summed for each pair."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    stand = classes.join(ids, "sig", "left_semi").select(F.pmod(F.xxhash64("doc_id", "th"), F.lit(WANTED)).alias("place"))
    wanted = source.sparkSession.sparkContext.broadcast(_wanted(stand))  # WANTED bits
    cut = store(_fragments(source, wanted, order, pivots, width), "fragments")
    of = lambda c: cut.select(F.col("sig").alias(c), "fragment", F.col("hashes").alias(f"h{c}"))
    met = pairs.join(of("a"), "a").join(of("b"), ["b", "fragment"])
    # Rows that repeat a document give the same part again: it counts once.
    parts = _overlap(met).groupBy("a", "b", "fragment").agg(F.max("part").alias("part"))
    whole = parts.groupBy("a", "b").agg(F.sum("part").alias("both"))
    of = lambda c: classes.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"))
    sized = whole.join(of("a"), "a").join(of("b"), "b")
    out = store(sized.where(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num).select("a", "b"), "links")
    discard(cut)
    wanted.unpersist()
    return out


# --- the join ---------------------------------------------------------------------------------------------------


def classified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """Of each row (doc_id, th, n, sig), and of each class (sig, class_id, th, component).

    ``th`` is the text's hash; class_id and th name the first document of a class, and ``component`` is the digest of
    one class of those that links connect.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    order = spark.sparkContext.broadcast(_counted(source, width))  # two arrays of CELLS bytes
    profiles = store(_profiles(source, id_type, order, width, num, den), "profiles")
    docs = profiles.where("levels is null").select("doc_id", "th", "n", "sig")
    pivots = _pivots(profiles)
    named = profiles.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("m"), F.first("n").alias("n"), F.max("bits").alias("bits"))
    classes = store(named.select("sig", "m.doc_id", "m.th", "n", "bits"), "classes")

    postings = profiles.where("tokens is not null").select("sig", "n", F.posexplode("tokens").alias("pos", "token")).select("token", "sig", "n", F.col("pos").cast("long").alias("pos"))
    lists = store(_short_lists(postings, num, den), "lists")
    rest = lists.where("b is null").select("token", F.col("a").alias("sig"), "n", "pos", "block", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"))
    bits = classes.select("sig", "bits")
    first = rest.join(bits, "sig").withColumns({"part": F.lit(None).cast("binary"), "side": F.lit(None).cast("int")})
    led = store(_pairs(first, num, den, True), "pairs")
    met = lists.where("b is not null").select("a", "b").unionByName(led.where("token is null").select("a", "b"))
    pairs = store(_narrowed(met, classes, num, den), "pairs")
    links = _verified(pairs, source, classes, order, pivots, width, num, den)
    found = components(links) if not links.isEmpty() else None

    # Long lists in which pairs were left out and that still hold several components: pairs of different components.
    left_out = led.where("token is not null").select("token").unionByName(rest.where("block > 0").select("token")).distinct()
    # What is known of a list is joined to shares of it: a very long list is dealt out over several tasks.
    shares = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    labelled = rest.withColumnRenamed("block", "mine").join(left_out.select("token", shares).hint("merge"), ["token", "salt"], "left_semi")
    if found is not None:
        labelled = labelled.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("part", F.coalesce("component", "sig")).drop("component")
    else:
        labelled = labelled.withColumn("part", F.col("sig"))
    several = labelled.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), (F.max("mine") + 1).alias("blocks")).where("low < high")
    open_ = labelled.join(several.select("token", "blocks", shares).hint("merge"), ["token", "salt"])
    # Each two blocks of a list meet once; within one block (side 2) all pairs count, between two only crossing ones.
    again = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    again = again.withColumn("block", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).withColumn("side", F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") < F.col("other")).cast("int")))
    more = store(_narrowed(_pairs(again.join(bits, "sig"), num, den, False).join(pairs, ["a", "b"], "left_anti"), classes, num, den), "pairs")
    for done in (lists, led, pairs):
        discard(done)
    if not more.isEmpty():
        further = _verified(more, source, classes, order, pivots, width, num, den)
        if not further.isEmpty():
            old, links = found, links.unionByName(further)
            found = components(links)
            if old is not None:
                discard(old)
    discard(more)
    out = classes.select("sig", F.col("doc_id").alias("class_id"), "th")
    if found is not None:
        out = out.join(found.withColumnRenamed("node", "sig"), "sig", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("binary"))
    return docs, out.withColumn("component", F.coalesce("component", "sig"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for each row: sets are linked from a similarity of num/den on.

    ``class_id`` is the smallest identifier with the same set, ``component_id`` the smallest that links lead to.
    """
    docs, classes = classified(df, id_col, text_col, width, num, den)
    least = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = classes.join(least, "component").select("sig", "class_id", "component_id")
    known = docs.where("sig is not null and doc_id is not null").join(named, "sig")
    # Empty sets have no class, and a third of all rows may be such: they are kept out of the join.
    none = docs.where("sig is null or doc_id is null").select("sig", "doc_id", "th", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return known.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row of ``df`` for each component, that with the smallest identifier, with all its columns.

    Rows without words or identifier are linked with nothing: all of them stay.
    """
    docs, classes = classified(df, id_col, text_col, width, num, den)
    one = classes.groupBy("component").agg(F.min(F.struct("class_id", "th")).alias("m")).select(F.col("m.class_id").alias("_courtlens_id"), F.col("m.th").alias("_courtlens_th"))
    free = docs.where("sig is null or doc_id is null").select(F.col("doc_id").alias("_courtlens_id"), F.col("th").alias("_courtlens_th"))
    kept = store(one.unionByName(free).distinct(), "kept")
    hashed = df.withColumn("_courtlens_th_of_text", F.xxhash64(F.col(text_col)))
    stay = hashed.join(kept, hashed[id_col].eqNullSafe(kept["_courtlens_id"]) & (F.col("_courtlens_th_of_text") == F.col("_courtlens_th")), "left_semi")
    # Rows that repeat both identifier and text: of those, one stays.
    again = docs.join(one, (F.col("doc_id") == F.col("_courtlens_id")) & (docs["th"] == F.col("_courtlens_th")), "left_semi").groupBy("doc_id", "th").agg(F.count("*").alias("k")).where("k > 1")
    again = store(again.select(F.col("doc_id").alias("_courtlens_id"), F.col("th").alias("_courtlens_th")), "kept")
    if not again.isEmpty():
        same = (F.col(id_col) == F.col("_courtlens_id")) & (F.col("_courtlens_th_of_text") == F.col("_courtlens_th"))
        stay = stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").dropDuplicates([id_col, "_courtlens_th_of_text"]))
    return stay.drop("_courtlens_th_of_text")


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
whole AS (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS k FROM s GROUP BY 1),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM whole)
SELECT doc_id, n AS n_shingles, coalesce(class_id, doc_id) AS class_id, min(r) AS component_id FROM reach JOIN n USING (doc_id) LEFT JOIN class USING (doc_id) GROUP BY 1, 2, 3
"""
