"""From raw documents to packed token sequences, in five stages that are each written and read again.

Edge cases: null, empty and short texts fail the first stage; of rows that repeat a text, or both identifier and text,
one stays; rows that share an identifier but not the text are judged each by its own text; documents without an
identifier are kept unless a text like theirs is; an empty table gives no pieces; columns other than those of
``documents`` are carried along up to the last stage.
"""

from __future__ import annotations

from courtlens.llm import jaccard, lsm, packing, perplexity, pii
from courtlens.llm.store import store, table


def quality(spark, docs, sf_dir):
    """Documents that the plain rules or the perplexity bands reject go."""
    return perplexity.accept(docs)


def exact_dedup(spark, docs, sf_dir):
    """Of texts that are equal but for white space one stays."""
    return lsm.deduplicate(docs)


def near_dedup(spark, docs, sf_dir):
    """Of documents that shingles of five words and a similarity of 0.8 connect one stays."""
    return jaccard.deduplicate(docs)


def redaction(spark, docs, sf_dir):
    """Personal data gives way to the name of its kind."""
    return pii.redact(docs)


def packed(spark, docs, sf_dir):
    """All that is left, packed into sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("redaction", redaction), ("packing", packed)]

#: The perplexity model of the first stage and the tokens of the last are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The packed pieces of the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
