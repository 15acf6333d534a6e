"""Ids of ``word_bpe_49k.json`` for whole texts, as the tokenizers library gives them.

Latin texts in normal form are split at white space (no token crosses it) and each different word is encoded
once; the merges run in tiktoken's core, over bytes with one more byte for the end of a word. All other texts
go through the library itself, as do texts that may hold the string of a special token: with the library's settings
that string is its id.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import tiktoken

END = b"\xff"  # stands for the end of a word; no UTF-8 text has this byte
#: Words that a worker keeps the ids of, and their bytes at most: a few MB.
CACHE_ENTRIES, CACHED_BYTES = 1 << 16, 24


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordCodec(dict):
    def __init__(self, path: str):
        super().__init__()
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, suffix = byte_letters(), model["end_of_word_suffix"]
        ranks = {}
        for token, i in model["vocab"].items():
            body, end = (token[: -len(suffix)], END) if token.endswith(suffix) and token != suffix else (token, b"")
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + end] = i
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        of = lambda kind: "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of('L')}]+|[{of('N')}]|[^\\s{of('L')}{of('N')}]+")
        self.other = re.compile("[^\x00-\x1b\x20-ɏ]")

    @functools.cached_property
    def library(self):
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        piece = self.core.encode_single_piece
        out = np.array([i for x in self.split.findall(word) for i in piece(x.encode() + END)], "<u4").tobytes()
        if len(word) <= CACHED_BYTES:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "<|" not in text and not self.other.search(text) and unicodedata.is_normalized("NFC", text):
            words = text.lower().split()
            if len(words) and max(map(len, words)) < 4096:
                return b"".join(map(self.__getitem__, words))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)
