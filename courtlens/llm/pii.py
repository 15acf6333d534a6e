"""Personal data in whole texts, disguised or not, with offsets into the text as it is.

Plain identifiers are found by four patterns. For disguised ones, transducers rewrite the text and keep, for each
part they change, where it came from: homoglyphs, full-width and other digits and invisible characters first, then
spelled digits, then ``at`` and ``dot`` in words or brackets. The same patterns then search what comes out, and
their spans are mapped back to source characters. Plain spans stay; mapped ones are added where no plain span of
their kind holds them already.

All spans are in code points, end exclusive. Every search is linear in the text: a disguise has at most eight blanks
on either side of a sign, so none of them looks further, and spans are compared in their order. ``x @ host.org`` counts
as it stands; the bare word ``at`` only where the name or the host tells that it is an address.

Edge cases: a null text is the empty text, without spans; repeated rows are judged alike, each for itself; an empty
table gives an empty result; of spans that start together the kind listed first, then the shorter one comes first; an identifier that
spans a rewritten part is reported with that whole part; columns other than the named ones are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import rows
from .store import table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def plain(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the four patterns, leftmost and non-overlapping within a kind, as read."""
    found = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


# --- transducers: each gives edits (start, end, replacement) in order -------------------------------------------

#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("авеікмнорсстухѕјһԁԛԝАВЕІКМНОРСТУХЅЈαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abeikmhopcctyxsjhdqwABEIKMHOPCTYXSJaeiknoptuxABEZHIKMNOPTYX", strict=True))
_SIGNS = {"﹫": "@", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", "　": " "}
_NOTHING = {c: "" for c in "­​‌‍⁠﻿"}
_FULL = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
_GLYPHS = _LOOKALIKES | _SIGNS | _NOTHING | _FULL
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + "]|[^\x00-ÿ\\W]")


def _glyphs(text: str) -> Iterator[tuple[int, int, str]]:
    if text.isascii():
        return
    for m in _GLYPH.finditer(text):
        c = m.group()
        to = _GLYPHS.get(c)
        if to is None and (d := unicodedata.decimal(c, None)) is not None:
            to = str(d)
        if to is not None:
            yield m.start(), m.end(), to


#: Digits as they are spelled in English, German, French and Spanish.
_SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_DIGIT_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_POINT = "dot|point|punkt|punto"
_DASH = "dash|hyphen"
_RUN = re.compile(rf"(?:\bplus[ ,-]+)?(?<![\w])(?:{_DIGIT_WORD})(?:[ ,.-]{{1,3}}(?:{_DIGIT_WORD}|{_POINT}|{_DASH}|[0-9]{{1,4}})(?!\w)){{3,}}", re.IGNORECASE)
_ELEMENT = re.compile(r"\w+")
#: A run of spelled digits counts as a number if it has so many different digits.
LEAST_DIFFERENT = 2


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _RUN.finditer(text):
        words = [w.lower() for w in _ELEMENT.findall(m.group())]
        if len({_SPELLED[w] for w in words if w in _SPELLED}) < LEAST_DIFFERENT:
            continue
        out = ""
        for w in words:
            out += "+" if w == "plus" else str(_SPELLED[w]) if w in _SPELLED else w if w.isdigit() else "-" if w in _DASH.split("|") else "."
        yield m.start(), m.end(), out


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_ANY, _SOME = r"\s{0,8}", r"\s{1,8}"
_AT = re.compile(rf"{_ANY}{_OPEN}{_ANY}(?:at|@|arroba){_ANY}{_CLOSE}{_ANY}|(?P<bare>{_SOME}(?:at|arroba){_SOME})|{_SOME}@{_ANY}|@{_SOME}|_at_|@", re.IGNORECASE)
_HIDDEN_DOT = rf"{_ANY}{_OPEN}{_ANY}(?:{_POINT}|\.){_ANY}{_CLOSE}{_ANY}|{_SOME}(?:{_POINT}){_SOME}|_dot_"
_ANY_HIDDEN_DOT = re.compile(_HIDDEN_DOT, re.IGNORECASE)
_DOT_BEFORE = re.compile(rf"(?:{_HIDDEN_DOT})\Z", re.IGNORECASE)
#: Characters of the longest hidden dot.
_DOT_LENGTH = 40
_ANY_HIDDEN_AT = re.compile(rf"{_OPEN}{_ANY}(?:at|@|arroba){_ANY}{_CLOSE}|\s(?:at|arroba){_SOME}[a-z0-9-]+\.[a-z0-9]|\s@|@\s|_at_", re.IGNORECASE)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:{_HIDDEN_DOT}|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
_HIDDEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_HIDDEN_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_TELLING = re.compile(r"[0-9._]")


def _local_before(text: str, free: int, end: int) -> int:
    """Where the local part that ends at ``end`` starts, over hidden dots; ``end`` where there is none."""
    start = at = end
    while True:
        while at > free and text[at - 1] in _LOCAL:
            at -= 1
        if at == start:
            return start if start == end else after
        start = after = at
        low = max(free, at - _DOT_LENGTH)
        dot = _DOT_BEFORE.search(text, low, at)
        if not dot:
            return start
        start = at = dot.start()


def _words(text: str) -> Iterator[tuple[int, int, str]]:
    dots = bool(_ANY_HIDDEN_DOT.search(text))
    if not dots and not _ANY_HIDDEN_AT.search(text):
        return
    edits: list[tuple[int, int, str]] = []
    free = 0
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        if not host or m.start() <= free:
            continue
        start = _local_before(text, free, m.start())
        if start == m.start():
            continue
        name, site = text[start : m.start()], host.group()
        hidden = _ANY_HIDDEN_DOT.search(site) is not None
        telling = _TELLING.search(name) and any(c.isalpha() for c in name)
        if m["bare"] and not hidden and not telling:
            continue
        free = host.end()
        to = f"{_ANY_HIDDEN_DOT.sub('.', name)}@{_ANY_HIDDEN_DOT.sub('.', site)}"
        if to != text[start:free]:
            edits.append((start, free, to))
    if dots:
        taken = [e[:2] for e in edits]  # in order, without overlaps
        for m in _HIDDEN_IP.finditer(text):
            to = _ANY_HIDDEN_DOT.sub(".", m.group())
            near = bisect_right(taken, (m.end() - 1, len(text)))
            if to != m.group() and not (near and taken[near - 1][1] > m.start()):
                edits.append((*m.span(), to))
    yield from sorted(edits)


class Rewritten:
    """A text after edits, and where each of its characters comes from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.at, self.source = [], [], []  # where parts start here; (start, end, changed) there
        here = there = 0
        for start, end, to in edits:
            for piece, a, b, changed in ((text[there:start], there, start, False), (to, start, end, True)):
                if piece:
                    parts.append(piece)
                    self.at.append(here)
                    self.source.append((a, b, changed))
                    here += len(piece)
            there = end
        if there < len(text):
            parts.append(text[there:])
            self.at.append(here)
            self.source.append((there, len(text), False))
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        def of(i, last):
            k = bisect_right(self.at, i) - 1
            a, b, changed = self.source[k]
            return (b if last else a) if changed else a + i - self.at[k] + last

        return of(start, False), of(end - 1, True)


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, plain), by start, then kind as listed, then end."""
    base = plain(text)
    steps, now = [], text
    for transducer in (_glyphs, _spelled, _words):
        if edits := list(transducer(now)):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    found = {(*s, True) for s in base}
    if steps:
        # Plain spans of a kind do not overlap: only the last one that starts before a mapped one can hold it.
        of = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
        for kind, start, end in plain(now):
            for step in reversed(steps):
                start, end = step.back(start, end)
            near = bisect_right(of[kind], (start, len(text) + 1))
            if not (near and of[kind][near - 1][1] >= end):
                found.add((kind, start, end, False))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): for each row, its spans as structs of kind, start, end and whether a plain pattern found it."""
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for some in rows(batch):
                ids, texts = zip(*some, strict=True)
                found = [[dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in spans(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, _SPAN_TYPE)], ["doc_id", "spans"])

    return source.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,plain:boolean>>")


def mask(text: str) -> str:
    out, at, until = [], 0, 0
    for kind, start, end, _ in spans(text):
        if start >= until:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = until = max(until, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with each span replaced by its kind in angle brackets; overlapping spans become one. Null texts stay null.

    ``length_col``, where it exists, is set to the new number of code points.
    """
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                clean = [t if t is None else mask(t) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    out = df.mapInArrow(run, df.schema)
    if length_col in df.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
    return out


def op5_pii(spark, sf_dir: str) -> DataFrame:
    def joined(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind, only_plain=False):
        return lambda s: (s["kind"] == kind) & (s["plain"] | F.lit(not only_plain))

    found = find(table(spark, sf_dir, "documents"))
    every = F.col("spans")
    return found.select(
        "doc_id",
        *(F.size(F.filter(every, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter(every, lambda s: s["plain"])), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
        *(F.size(F.filter(every, of_kind(k, True))).cast("long").alias(f"n_base_{k}") for k in KINDS),
    )
