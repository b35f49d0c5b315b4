"""Encoding whole texts with a public word-level BPE vocabulary, with a bounded word cache.

The vocabulary drops white space and never joins across it, so a text's ids are the
ids of its white-space words in order. Natural text repeats words, so each worker
keeps the ids of words it has met; the tokenizer itself only sees new ones.
"""
from __future__ import annotations

import os
import re
from array import array

WORD_BPE = "word_bpe_49k.json"
#: Words a worker remembers (about 150 MB); beyond that it starts anew.
CACHE_WORDS = 1_000_000
#: Latin letters, for which normalizing only lowers and splitting changes nothing, then punctuation (no
#: apostrophe, which opens suffixes), which is one piece of its own.
_LATIN = re.compile(r"([a-zß-öø-ÿÀ-ÖØ-Þ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder(dict):
    """bytes of a lower-cased word -> its ids as little-endian unsigned 16-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.marks: dict[str, bytes] = {"": b""}

    def _plain(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, text: str) -> bytes:
        """Ids of one word of Latin letters: the merges alone, without normalizing and splitting."""
        shown = text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
        return array("H", [t.id for t in self.merge(shown)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.marks = {"": b""}
        if word.isalpha():  # ASCII letters, already lower-cased
            ids = self[word] = array("H", [t.id for t in self.merge(word.decode("ascii"))]).tobytes()
            return ids
        text = word.decode("utf-8", "replace")
        parts = _LATIN.fullmatch(text)
        if not parts:
            ids = self._plain(text)
        elif not parts[2]:
            ids = self._letters(text.lower())
        else:
            if parts[2] not in self.marks:
                self.marks[parts[2]] = self._plain(parts[2])
            ids = self[parts[1].lower().encode()] + self.marks[parts[2]]
        self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text; null counts as empty."""
        text = text or ""
        if "<|" in text:  # might hold a special token, whose spelling is case-sensitive
            return self._plain(text)
        get = self.__getitem__
        return b"".join(map(get, text.encode("utf-8", "replace").lower().split()))


_READY: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _READY:
        _READY[path] = WordEncoder(path)
    return _READY[path]


def default_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
