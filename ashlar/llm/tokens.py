"""Fast exact encoding with the public tokenizers: the ids are the tokenizers library's own for every text.

The byte-level vocabulary is read from its file and applied by tiktoken, whose cut of a text is the library's (the tests
compare every code point); what tiktoken refuses, such as very long runs of white space, goes to the library.

The word vocabulary treats text between white space on its own, so the ids of a text are its words' ids in a row.  A
word is looked up; a new one is cut and encoded by the library (plain words of Latin letters and closing punctuation go
straight to its BPE model, which gives the same ids).

Texts that hold the string of a special token are encoded by the library as a whole: it gives the string one id.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Cached words; the cache starts anew beyond it, so a worker's memory is bounded.
WORDS = 500_000
#: How byte-level vocabularies of this family cut a text.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_map() -> dict[int, str]:
    """The printable characters that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in out)}


_CHARS = _byte_map()
#: Letters (Latin, precomposed, with a simple lower case) and then punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ž]+)([!-/:-@\[-`{-~]*)")


class Encoder:
    """ids(text) as little-endian unsigned 32-bit bytes: the library itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        return self.whole(text) if any(s in text for s in self.special) else self.plain(text)

    def plain(self, text: str) -> bytes:
        return self.whole(text)


class ByteEncoder(Encoder):
    """A byte-level vocabulary whose merges stand in the order of their ids."""

    def __init__(self, path: str, model: dict):
        super().__init__(path)
        import tiktoken

        byte = {c: b for b, c in _CHARS.items()}
        ranks = {bytes(byte[c] for c in k): i for k, i in model["vocab"].items()}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()
        except ValueError:  # its regular expression ran out of stack
            return self.whole(text)


class WordEncoder(Encoder):
    """Lower case, white space dropped, a mark at the end of each word."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.library.model
        self.table = str.maketrans({chr(b): c for b, c in _CHARS.items()})
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _part(self, piece: str) -> bytes:
        got = self.parts.get(piece)
        if got is None:
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
            got = self.parts[piece] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return got

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if not plain:
            return self.whole(word)
        letters, rest = plain.groups()
        first = self._part(letters.lower())
        return first + self._part(rest) if rest else first

    def plain(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        words = self.words
        try:
            return b"".join([words[w] for w in pieces])
        except KeyError:
            pass
        if len(words) > WORDS:
            words.clear()
            self.parts.clear()
            words[""] = b""
        for w in pieces:
            if w not in words:
                words[w] = self._word(w)
        return b"".join([words[w] for w in pieces])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process; a vocabulary of an unknown kind is left to the library."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, cut = made["model"], made["pre_tokenizer"]
    if model["type"] == "BPE" and cut["type"] == "ByteLevel" and not made["normalizer"] and cut["use_regex"] and not cut["add_prefix_space"]:
        merged = [model["vocab"]["".join(m)] for m in model["merges"]]
        if merged == sorted(merged) and merged[0] >= 256:
            return ByteEncoder(path, model)
    if model["type"] == "BPE" and model["end_of_word_suffix"] and any(n["type"] == "Lowercase" for n in (made["normalizer"] or {}).get("normalizers", [])):
        return WordEncoder(path)
    return Encoder(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
