"""Quality rules: a few plain counts, and bands of n-gram perplexity by language.

The model is a modified Kneser-Ney model of order 5 over characters as they are. Spark counts the n-grams of all
documents, by language and by half: texts are dealt into two halves by their hash, and a document is scored by the
model of the half that it is not in, so that no text, and no copy of one, vouches for itself. Counts are merged and
estimated by language, half and the character before the last one, which all orders of an n-gram share but the
first. What comes out is written: sorted arrays of 64-bit hashes with log probabilities, and of contexts with their
weights. It grows with the input, and reaches the workers in shards of bounded size, one broadcast each; a worker
holds one shard at a time and adds up what each shard says of a batch of texts.

A document is rejected when its perplexity lies outside the band of its language: around the median, as many deviations
as ``below`` and ``above`` say, and wider for short texts. Median and deviation come from a histogram over all documents.

Edge cases: a null text has no words and fails the plain rules; a null language counts as a language of its
own, ``und``; a text without characters, or in a language of which the other half has no text, has no perplexity and is
judged by the plain rules alone; repeated rows are judged alike and all counted; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import made, rows
from .shingles import mixed, runs, words
from .store import discard, store, table

ORDER = 5
#: Symbols that a model without any evidence chooses from: the code points. Symbol 0 stands before a text.
SYMBOLS = 0x110000
NO_LANGUAGE = "und"
#: How far a band reaches below and above the median, in scaled median absolute deviations. Too regular texts lie
#: close below it. Texts with a passage in another language are in order and lie up to seven above it; texts of
#: random characters, and those that are for the most part in another language than they say, lie further up.
BELOW, ABOVE = 4.0, 8.0
#: The least deviation, in nats a character.
LEAST_DEVIATION = 0.02
#: What one character adds to the deviation of a text's mean, in nats.
NOISE = 1.2
#: Cells of the histogram for one nat.
CELLS = 200
#: Characters whose n-grams are counted before they are sorted, and different n-grams that a task holds.
BUFFER, MOST_HELD = 1 << 21, 1 << 20
#: Groups by the character before the last, and bytes of a shard of the model.
BUCKETS, SHARD_BYTES = 61, 32 << 20
#: Characters that are scored at once.
PIECE = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: What tells n-grams of one order from those of another.
_TAGS = [np.uint64(k * 0xD1B54A32D192ED03 % 2**64) for k in range(ORDER + 1)]


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some texts, each behind ORDER - 1 zeros, and where they start."""
    pad = "\0" * (ORDER - 1)
    data = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + ORDER - 1 for t in texts])
    return data, ends - [len(t) for t in texts]


def _sums(symbols: np.ndarray, at: np.ndarray | slice, k: int) -> np.ndarray:
    """Polynomials of the last ``k`` symbols up to each place."""
    if isinstance(at, slice):
        out = np.zeros(at.stop - at.start, np.uint64)
        for j in reversed(range(k)):
            out = out * _FACTOR + symbols[at.start - j : at.stop - j]
        return out
    out = np.zeros(len(at), np.uint64)
    for j in reversed(range(k)):
        out = out * _FACTOR + symbols[at - j]
    return out


def keys(sums: np.ndarray, seed, k: int) -> np.ndarray:
    return mixed(sums + seed + _TAGS[k])


def seed_of(lang: str, half: int) -> np.uint64:
    """What tells the n-grams of one model from those of another."""
    return runs(next(words(pa.array([f"{lang.encode().hex()} {half}"])))[1], 2)[0]


# --- counts -----------------------------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _matrix(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<u4").reshape(ORDER, -1)


def _merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of ``grams`` (ORDER rows) and their summed counts."""
    h = np.zeros(grams.shape[1], np.uint64)
    for row in grams:
        h = h * _FACTOR + row
    h = mixed(h)
    order = np.argsort(h)
    starts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    return grams[:, order[starts]], np.add.reduceat(counts[order], starts)


class _Counter:
    """The n-grams of one model, as far as a task has seen them. What is new is merged when it is as much as what is held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.held = 0

    def add(self, symbols: np.ndarray, at: np.ndarray) -> None:
        """Count the n-grams that end at some places."""
        h = mixed(_sums(symbols, slice(ORDER - 1, len(symbols)), ORDER))[at - ORDER + 1]
        order = np.argsort(h)
        h = h[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        one = at[order[starts]]
        self.take(np.stack([symbols[one - j] for j in reversed(range(ORDER))]), np.diff(np.append(starts, len(h))))

    def take(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((grams, counts))
        self.size += len(counts)
        if self.size - self.held > max(self.held, MOST_HELD // 8):
            self.settled()

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [_merged(np.concatenate([g for g, _ in self.parts], axis=1), np.concatenate([c for _, c in self.parts]))]
        self.size = self.held = len(self.parts[0][1])
        return self.parts[0]


def _source(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    th = F.xxhash64(F.col(text_col))
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"), th.alias("th"), F.pmod(th, F.lit(2)).cast("int").alias("half"))


_GROUP = ["lang", "half", "bucket"]
_COUNTS = ([*_GROUP, "grams", "counts"], [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])


def gram_counts(source: DataFrame) -> DataFrame:
    """(lang, half, bucket, grams, counts): the different n-grams of all documents, a row for each bucket."""

    def run(batches):
        held: dict[tuple, list[str]] = {}
        sums: dict[tuple, _Counter] = {}
        size = 0

        def settle():
            for key, texts in held.items():
                symbols, starts = _symbols(texts)
                inner = np.ones(len(symbols), bool)
                inner[(starts[:, None] - 1 - np.arange(ORDER - 1)).ravel()] = False
                sums.setdefault(key, _Counter()).add(symbols, np.flatnonzero(inner))
            held.clear()
            return sum(c.size for c in sums.values())

        def sent():
            for (lang, half), counter in sums.items():
                grams, counts = counter.settled()
                order = np.lexsort([*grams[::-1], grams[-2] % BUCKETS])
                grams, counts = grams[:, order], counts[order]
                buckets = grams[-2] % BUCKETS
                cuts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
                yield made([(lang, half, int(buckets[a]), _packed(grams[:, a:b]), _packed(counts[a:b])) for a, b in itertools.pairwise(cuts)], *_COUNTS)
            sums.clear()

        for batch in batches:
            for some in rows(batch):
                for lang, half, text in some:
                    for low in range(0, len(text), BUFFER):  # a long text in parts that overlap by a context
                        part = text[max(0, low - ORDER + 1) : low + BUFFER]
                        if low:
                            symbols = np.frombuffer(part.encode("utf-32-le"), np.uint32)
                            sums.setdefault((lang, half), _Counter()).add(symbols, np.arange(ORDER - 1, len(symbols)))
                        else:
                            held.setdefault((lang, half), []).append(part)
                        size += len(part)
                        if size >= BUFFER:
                            size = 0
                            if settle() >= MOST_HELD:
                                yield from sent()
        settle()
        yield from sent()

    def merge(batches):
        key, counter = None, _Counter()

        def ended():
            if key is not None:
                grams, counts = counter.settled()
                yield made([(*key, _packed(grams), _packed(counts))], *_COUNTS)

        for batch in batches:
            for some in rows(batch, 16):
                for *group, grams, counts in some:
                    if tuple(group) != key:
                        yield from ended()
                        key, counter = tuple(group), _Counter()
                    counter.take(_matrix(grams), np.frombuffer(zlib.decompress(counts), "<i8"))
        yield from ended()

    types = "lang string, half int, bucket int, grams binary, counts binary"
    each = source.where("text <> ''").select("lang", "half", "text").mapInArrow(run, types)
    return each.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(merge, types)


# --- the model --------------------------------------------------------------------------------------------------


def discounts(n: list[int]) -> np.ndarray:
    """The discounts of counts of one, two, and three or more; ``n``: how many counts are 1, 2, 3 and 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.array([min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k * 0.5 for k in (1, 2, 3)])


def _levels(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams, counts, place of its shorter one in the next level) from order ORDER down to 2, of one bucket.

    Lower orders count the different symbols that stand before an n-gram.
    """
    out = []
    while True:
        k = len(grams)
        if k == 2:
            out.append((grams, counts, None))
            return out
        h = np.zeros(grams.shape[1], np.uint64)
        for row in grams[1:]:
            h = h * _FACTOR + row
        _, at, where, n = np.unique(mixed(h), return_index=True, return_inverse=True, return_counts=True)
        out.append((grams, counts, where))
        grams, counts = grams[1:, at], n


def _hashes(grams: np.ndarray, seed, k: int) -> np.ndarray:
    h = np.zeros(grams.shape[1], np.uint64)
    for row in grams:
        h = h * _FACTOR + row
    return keys(h, seed, k)


def count_of_counts(grams: np.ndarray, counts: np.ndarray) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """How many counts are 1 to 4 in each order from 2 on, and the symbols with how many come before them."""
    levels = _levels(grams, counts)
    shared = [[int((c == i).sum()) for i in (1, 2, 3, 4)] for _, c, _ in reversed(levels)]
    symbols, n = np.unique(levels[-1][0][1], return_counts=True)
    return shared, symbols, n


class Unigrams(NamedTuple):
    """Of one model: log probabilities of single symbols, that of any other symbol, and discounts from order 2 on."""

    symbols: np.ndarray
    logp: np.ndarray
    other: float
    discounts: list[np.ndarray]


def unigrams(symbols: np.ndarray, n: np.ndarray, of_counts: list[list[int]]) -> Unigrams:
    order = np.argsort(symbols)
    symbols, n = symbols[order], n[order].astype(np.float64)
    d = discounts([int((n == i).sum()) for i in (1, 2, 3, 4)])[np.minimum(n, 3).astype(np.int64) - 1]
    floor = d.sum() / n.sum() / SYMBOLS
    return Unigrams(symbols, np.log((n - d) / n.sum() + floor), float(np.log(max(floor, 1e-12))), [discounts(c) for c in of_counts])


def estimate(grams: np.ndarray, counts: np.ndarray, base: Unigrams, seed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and log probabilities of the n-grams of a bucket, hashes and log weights of their contexts, by hash."""
    levels = _levels(grams, counts)
    found, contexts = [], []
    p = None
    for (g, c, _), shorter, d in zip(reversed(levels), [None, *(w for _, _, w in reversed(levels[:-1]))], base.discounts, strict=True):
        k = len(g)
        taken = d[np.minimum(c, 3) - 1]
        _, at, where = np.unique(_hashes(g[:-1], np.uint64(0), k - 1), return_index=True, return_inverse=True)
        total = np.bincount(where, c)
        spare = np.maximum(np.bincount(where, taken) / total, 1e-9)
        lower = np.exp(base.logp[np.searchsorted(base.symbols, g[1])]) if p is None else p[shorter]
        p = (c - taken) / total[where] + spare[where] * lower
        found.append((_hashes(g, seed, k), np.log(p)))
        contexts.append((_hashes(g[:-1, at], seed, k - 1), np.log(spare)))
    out = []
    for parts in (found, contexts):
        h, x = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        by = np.argsort(h)
        out += [h[by], x[by].astype(np.float32)]
    return tuple(out)


class Sorted:
    """A sorted array of hashes with a table of where each prefix starts, and a number for each hash."""

    def __init__(self, h: np.ndarray, x: np.ndarray):
        by = np.argsort(h)
        self.h, self.x = np.append(h[by], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(x[by], np.float32(0))
        bits = max(1, int(len(h)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.h[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and whether there are any. Each different hash is looked up once, in order, as the array lies in memory."""
        order = np.argsort(h)
        own = h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = own[1:] != own[:-1]
        own = own[fresh]
        at = self.first[own >> self.shift]
        behind = np.flatnonzero(self.h[at] < own)
        while len(behind):
            at[behind] += 1
            behind = behind[self.h[at[behind]] < own[behind]]
        which = np.empty(len(h), np.int32)
        which[order] = np.cumsum(fresh, dtype=np.int32) - 1
        return self.x[at][which], (self.h[at] == own)[which]


class Shard(NamedTuple):
    grams: Sorted
    contexts: Sorted


class Model:
    """Broadcast shards, the single symbols of each model, and which shard has which (lang, half, bucket)."""

    def __init__(self, shards: list, singles: dict[tuple[str, int], Unigrams], where: dict[tuple, int]):
        self.shards, self.singles = shards, singles
        self.seeds = {key: seed_of(*key) for key in singles}
        self.places = {key: np.array([where.get((*key, b), 0) for b in range(BUCKETS)]) for key in singles}

    def log_probabilities(self, texts: list[str], models: list[tuple[str, int]]) -> np.ndarray:
        """The mean log probability of the symbols of each text by its model; NaN where there is none."""
        out = np.full(len(texts), np.nan)
        known = [i for i, (t, m) in enumerate(zip(texts, models, strict=True)) if t and m in self.singles]
        if not known:
            return out
        own = [texts[i] for i in known]
        symbols, starts = _symbols(own)
        sizes = np.array([len(t) for t in own])
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        kinds = {m: n for n, m in enumerate(dict.fromkeys(models[i] for i in known))}
        kind = np.repeat(np.array([kinds[models[i]] for i in known], np.int32), sizes)
        seed = np.array([self.seeds[m] for m in kinds], np.uint64)[kind]
        score = np.zeros(len(at))
        if len(self.shards) == 1:
            open_ = _scored(_value(self.shards[0], True), symbols, at, seed, score, np.arange(len(at)))
        else:
            shard = np.stack([self.places[m] for m in kinds])[kind, symbols[at - 1] % BUCKETS]
            open_ = np.concatenate([_scored(_value(s, False), symbols, at, seed, score, mine) for n, s in enumerate(self.shards) if len(mine := np.flatnonzero(shard == n))])
        for m, n in kinds.items():
            base, mine = self.singles[m], open_[kind[open_] == n]
            one = symbols[at[mine]]
            found = np.minimum(np.searchsorted(base.symbols, one), len(base.symbols) - 1)
            score[mine] += np.where(base.symbols[found] == one, base.logp[found], base.other)
        out[known] = np.add.reduceat(score, np.cumsum(sizes) - sizes) / sizes
        return out


def _value(shard, keep: bool) -> Shard:
    """A shard; a worker keeps it only if it is the only one."""
    value = shard.value
    if not keep and hasattr(shard, "_value"):
        del shard._value
    return value


def _scored(shard: Shard, symbols: np.ndarray, at: np.ndarray, seed: np.ndarray, score: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Add to the scores of some places: the log probability of the longest known n-gram, and the weights of longer contexts.

    Gives the places of which only the single symbol is left.
    """
    for k in range(ORDER, 1, -1):
        x, hit = shard.grams.find(keys(_sums(symbols, at[open_], k), seed[open_], k))
        score[open_[hit]] += x[hit]
        open_ = open_[~hit]
        if not len(open_):
            break
        x, hit = shard.contexts.find(keys(_sums(symbols, at[open_] - 1, k - 1), seed[open_], k - 1))
        score[open_[hit]] += x[hit]
    return open_


def fit(source: DataFrame) -> tuple[Model, DataFrame]:
    """The models of all languages and halves, and the table that they are written in.

    Single symbols and counts of counts come to the driver, and one shard at a time.
    """
    spark = source.sparkSession
    counted = store(gram_counts(source), "grams")

    def stats(batches):
        for batch in batches:
            for some in rows(batch, 1):
                for lang, half, grams, counts in some:
                    of_counts, symbols, n = count_of_counts(_matrix(grams), np.frombuffer(zlib.decompress(counts), "<i8"))
                    yield made([(lang, half, np.array(of_counts).ravel(), symbols.astype(np.int32), n)], ["lang", "half", "of_counts", "symbols", "n"], [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())])

    told = store(counted.select("lang", "half", "grams", "counts").mapInArrow(stats, "lang string, half int, of_counts array<long>, symbols array<int>, n array<long>"), "stats")
    of_counts: dict[tuple, np.ndarray] = {}
    for r in told.select("lang", "half", F.posexplode("of_counts")).groupBy("lang", "half", "pos").agg(F.sum("col").alias("n")).toLocalIterator():
        of_counts.setdefault((r["lang"], r["half"]), np.zeros(4 * (ORDER - 1), np.int64))[r["pos"]] = r["n"]
    symbols: dict[tuple, list] = {}
    for r in told.select("lang", "half", F.explode(F.arrays_zip("symbols", "n")).alias("x")).groupBy("lang", "half", "x.symbols").agg(F.sum("x.n").alias("n")).toLocalIterator():
        symbols.setdefault((r["lang"], r["half"]), []).append((r["symbols"], r["n"]))
    singles = {key: unigrams(*np.array(found).T, of_counts[key].reshape(-1, 4).tolist()) for key, found in symbols.items()}
    discard(told)
    known = spark.sparkContext.broadcast(singles)  # code points of each language

    def estimated(batches):
        for batch in batches:
            for some in rows(batch, 1):
                for lang, half, bucket, grams, counts in some:
                    found = estimate(_matrix(grams), np.frombuffer(zlib.decompress(counts), "<i8"), known.value[lang, half], seed_of(lang, half))
                    yield made([(lang, half, bucket, sum(x.nbytes for x in found), *(x.tobytes() for x in found))], [*_GROUP, "size", "gh", "gx", "ch", "cx"], [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4])

    model = store(counted.mapInArrow(estimated, "lang string, half int, bucket int, size long, gh binary, gx binary, ch binary, cx binary"), "model")
    discard(counted)
    where, no, held = {}, 0, 0
    for r in model.select(*_GROUP, "size").orderBy(*_GROUP).toLocalIterator():
        if held and held + r["size"] > SHARD_BYTES:
            no, held = no + 1, 0
        where[r["lang"], r["half"], r["bucket"]] = no
        held += r["size"]
    shards = []
    named = spark.createDataFrame([(*key, n) for key, n in where.items()], "lang string, half int, bucket int, shard int")
    dealt = model.join(F.broadcast(named), _GROUP)  # a row for each bucket of each language
    for n in range(no + 1 if where else 0):
        parts = [tuple(np.frombuffer(r[c], t) for c, t in (("gh", "<u8"), ("gx", "<f4"), ("ch", "<u8"), ("cx", "<f4"))) for r in dealt.where(F.col("shard") == n).select("gh", "gx", "ch", "cx").toLocalIterator()]
        gh, gx, ch, cx = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        shards.append(spark.sparkContext.broadcast(Shard(Sorted(gh, gx), Sorted(ch, cx))))  # SHARD_BYTES, or one bucket
    return Model(shards, singles, where), model


# --- plain counts -----------------------------------------------------------------------------------------------

_SIGNS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"


def repeated_words(h: np.ndarray) -> int:
    """Words in windows of five that occur twice or more, the first included."""
    w = runs(h, 5)
    order = np.argsort(w)
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(h) + 1, np.int64)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, starts, 1)
    np.add.at(twice, starts + 5, -1)
    return int((np.cumsum(twice) > 0).sum())


def _plain(column: pa.Array, texts: list) -> Iterator[tuple[int, int, int, int, int]]:
    for low, h, bounds in words(column, lower=False):
        for i in range(len(bounds) - 1):
            text, own = texts[low + i] or "", h[bounds[i] : bounds[i + 1]]
            data = text.encode()
            seen, dup = set(), 0
            for line in data.split(b"\n"):
                if line in seen:
                    dup += 1
                elif line and line.translate(None, _BLANKS):
                    seen.add(line)
            blanks = len(data) - len(data.translate(None, _BLANKS))
            yield len(own), len(text) - blanks, len(data) - len(data.translate(None, _SIGNS)), dup, repeated_words(own) if len(own) > 5 else 0


def plain_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    return next(_plain(pa.array([text], pa.string()), [text]))


_NAMES = ["doc_id", "th", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "log_perplexity"]


def measures(source: DataFrame, model: Model) -> DataFrame:
    """(doc_id, th, lang, the plain counts, n_chars, log_perplexity) for each row."""
    id_type = source.schema["doc_id"].dataType.simpleString()

    def scored(texts, models):
        """In pieces of bounded size; a text of many pieces is scored as their mean, each with the context before it."""
        low, out = 0, []
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= PIECE):
                size += len(texts[high])
                high += 1
            out.append(model.log_probabilities(texts[low:high], models[low:high]))
            low = high
        return np.concatenate(out)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                models = [(lang, 1 - half) for lang, half in zip(langs, part.column("half").to_pylist(), strict=True)]
                lp = -scored([t or "" for t in texts], models)
                counts = list(zip(*_plain(part.column("text"), texts), strict=True))
                arrays = [part.column("doc_id"), part.column("th"), part.column("lang"), *(pa.array(c, pa.int64()) for c in counts), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(lp, mask=np.isnan(lp))]
                yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    return source.mapInArrow(run, f"doc_id {id_type}, th long, lang string, " + ", ".join(f"{n} long" for n in _NAMES[3:9]) + ", log_perplexity double")


def _quantile(cells: list[tuple[float, int]], q: float) -> float:
    total, run = sum(n for _, n in cells), 0
    for value, n in sorted(cells):
        run += n
        if run >= q * total:
            return value
    return 0.0


def bands(measured: DataFrame) -> Iterator[tuple[str, float, float]]:
    """(lang, median, deviation) of log perplexity, from a histogram with a bounded number of cells."""
    top = int(CELLS * 25)
    cell = F.least(F.round(F.col("log_perplexity") * CELLS).cast("int"), F.lit(top))
    by: dict[str, list] = {}
    for r in measured.where("log_perplexity is not null").groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n")).toLocalIterator():
        by.setdefault(r["lang"], []).append((r["cell"] / CELLS, r["n"]))
    for lang, cells in by.items():
        middle = _quantile(cells, 0.5)
        yield lang, middle, max(LEAST_DEVIATION, 1.4826 * _quantile([(abs(v - middle), n) for v, n in cells], 0.5))


def _judged(df: DataFrame, id_col: str, text_col: str, lang_col: str, below: float, above: float) -> DataFrame:
    source = _source(df, id_col, text_col, lang_col)
    model, written = fit(source)
    measured = store(measures(source, model), "perplexity")
    for shard in model.shards:
        shard.unpersist()
    discard(written)
    known = df.sparkSession.createDataFrame(list(bands(measured)), "lang string, middle double, deviation double")
    unit = F.col("deviation") + NOISE / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1)))
    out = measured.join(F.broadcast(known), "lang", "left")  # a row for each language, from the driver
    out = out.withColumns({"low": F.col("middle") - below * unit, "high": F.col("middle") + above * unit})
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    inside = F.col("log_perplexity").isNull() | F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """The plain counts of each row, ``base_failed``, ``perplexity`` with its band, and ``kept``."""
    found = _judged(df, id_col, text_col, lang_col, below, above)
    return found.select("doc_id", *_NAMES[3:8], "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"), F.exp("low").alias("lower"), F.exp("high").alias("upper"))


def accept(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns; each is judged by its own text and language."""
    found = _judged(df, id_col, text_col, lang_col, below, above).where("kept")
    kept = found.select(F.col("doc_id").alias("_courtlens_id"), F.col("th").alias("_courtlens_th"), F.col("lang").alias("_courtlens_lang")).distinct()
    same = df[id_col].eqNullSafe(kept["_courtlens_id"]) & (F.xxhash64(df[text_col]) == kept["_courtlens_th"]) & (F.coalesce(df[lang_col], F.lit(NO_LANGUAGE)) == kept["_courtlens_lang"])
    return df.join(kept, same, "left_semi")


def op10_perplexity(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
