"""Language identification: the family first, then one-versus-one linear support vector machines within it.

A text is a vector of its letters' hashed byte n-grams (1 to 3 bytes), as square roots of their shares. A linear
classifier with one machine for each family picks the family; within it each two languages have a machine of
their own, and the language with the most votes wins, then the one with the larger sum of margins.

The machines are trained on a sample of labelled rows: all of them up to ``SAMPLE`` rows a language, beyond that
those with the smallest hashes of their identifiers, about ``SAMPLE`` in number. Whole texts are read, for
training as for prediction.

Edge cases: a null text or one without letters is ``und`` with a score of 0; a null language is no label; with
one language to learn it is the answer for all other texts, with none ``und`` is; repeated rows are judged alike.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import rows
from .store import table

#: Languages by family; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
    "malayic": "id ms",
}
CELLS = 1 << 12
SAMPLE = 400
EPOCHS, PENALTY = 300, 1e-4


def family(language: str) -> str:
    short = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in FAMILIES.items() if short in members.split()), language)


@functools.lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes as lower-case letters, or 0 for what is none; and three tables of hashed places."""
    letter = np.zeros(256, np.uint8)
    letter[128:] = np.arange(128, 256)
    for c in range(26):
        letter[65 + c] = letter[97 + c] = 97 + c
    return letter, np.random.default_rng(7).integers(0, CELLS, (3, 256), dtype=np.int64)


def vector(text: str | None) -> np.ndarray | None:
    """None for texts without letters."""
    if not text or not any(map(str.isalpha, text)):
        return None
    letter, place = _bytes()
    s = letter[np.frombuffer(text.lower().encode(), np.uint8)]
    s = np.concatenate([[0], s[(s != 0) | np.append(s[1:] != 0, False)], [0]])  # one gap between words
    one = place[0][s]
    two = (one[:-1] * 31 + place[1][s[1:]] + 1) % CELLS
    three = (two[:-1] * 37 + place[2][s[2:]] + 2) % CELLS
    v = np.sqrt(np.bincount(np.concatenate([one, two, three]), minlength=CELLS))
    return (v / np.linalg.norm(v)).astype(np.float32)


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear support vector machine (squared hinge) for labels -1 and 1, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = before = np.zeros(x.shape[1], np.float32)
    step = 1 / (2 * 2 + PENALTY)  # rows have a norm of at most the root of 2
    for k in range(EPOCHS):
        at = w + (k / (k + 3)) * (w - before)
        slack = np.maximum(0, 1 - y * (x @ at))
        before, w = w, at - step * (PENALTY * at - 2 * ((share * slack * y) @ x))
    return w


class Identifier:
    def __init__(self, x: np.ndarray, languages: list[str]):
        languages = np.array(languages)
        self.of: dict[str, list[str]] = {}
        for lang in sorted(set(languages.tolist())):
            self.of.setdefault(family(lang), []).append(lang)
        self.families = sorted(self.of)
        fam = np.array([family(lang) for lang in languages])
        self.by_family = np.stack([_machine(x, np.where(fam == f, 1, -1).astype(np.float32)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for members in self.of.values():
            for a, b in itertools.combinations(members, 2):
                own = (languages == a) | (languages == b)
                self.pairs[a, b] = _machine(x[own], np.where(languages[own] == a, 1, -1).astype(np.float32))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        v = np.append(v, np.float32(1))
        score, chosen = 1.0, self.families[0]
        if self.by_family is not None:
            margins = self.by_family @ v
            top = int(margins.argmax())
            chosen = self.families[top]
            score = 1 / (1 + np.exp(-4 * float(margins[top])))
        members = self.of[chosen]
        votes, sums, sure = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), {}
        for a, b in itertools.combinations(members, 2):
            m = float(self.pairs[a, b] @ v)
            votes[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
            sure[a, b] = 1 / (1 + np.exp(-4 * abs(m)))
        best = min(members, key=lambda lang: (-votes[lang], -sums[lang], lang))
        if own := [p for pair, p in sure.items() if best in pair]:
            score *= float(np.mean(own))
        return best, float(min(1.0, max(0.0, score)))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Identifier | None:
    """Fit on the rows of ``df`` that have a language; None where there are none."""
    source = df.where(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in source.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # A share of each language's rows, so that about `sample` are left of each.
    scale = 1 << 30
    place = F.pmod(F.xxhash64("id"), F.lit(scale))
    taken = F.lit(False)
    for lang, n in counts.items():
        taken = taken | ((F.col("lang") == lang) & (place < F.lit(int(scale * min(1.0, sample / n)))))

    def run(batches):
        for batch in batches:
            for some in rows(batch):
                kept = [(lang, v) for _, text, lang in some if (v := vector(text)) is not None]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept]), pa.array([k[1].tobytes() for k in kept], pa.binary())], ["lang", "v"])

    found = source.where(taken).mapInArrow(run, "lang string, v binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    return Identifier(np.stack([np.frombuffer(r["v"], np.float32) for r in found]), [r["lang"] for r in found])


def identify(df: DataFrame, model: Identifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(model)  # a few machines of CELLS weights

    def run(batches):
        for batch in batches:
            for some in rows(batch):
                found = [("und", 0.0) if held.value is None or (v := vector(text)) is None else held.value.predict(v) for _, text in some]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], batch.schema.field(0).type), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
