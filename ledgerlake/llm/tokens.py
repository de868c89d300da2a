"""Token ids of texts by a public tokenizer file (its path is a parameter).

The tokenizer's pre-tokenizer never joins text across ASCII white space, nor
letters with the punctuation after them, so a text's ids are the ids of these
parts in turn. Parts repeat, so each worker keeps a bounded table part -> ids;
a new part made of Latin letters goes straight to the tokenizer's BPE model
(its normaliser only lower-cases and composes such a part), any other part
through the whole tokenizer."""

from __future__ import annotations

import os
import unicodedata
from array import array

from .common import Cache, words

# punctuation that the pre-tokenizer cuts from letters before it
_TAIL = b".,;:!?|#$%&*"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """text -> little-endian uint32 ids as bytes. ``words`` holds whole words
    and ``parts`` their letters and punctuation; both are emptied when full."""

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, [byte_letters()[b] for b in range(256)]
        self.parts, self.words = Cache(self._part, limit), Cache(self._word, limit)

    def plain(self, s: str) -> bytes:
        return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()

    def _bpe(self, s: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(s)]).tobytes()

    def _part(self, w: bytes) -> bytes:
        if w.isalpha():  # ASCII
            return self._bpe(w.decode("ascii"))
        s = w.decode("utf-8")
        if s.isalpha() and max(s) < "ɐ" and "İ" not in s:  # Latin letters
            return self._bpe("".join([self.letters[b] for b in unicodedata.normalize("NFC", s).lower().encode("utf-8")]))
        return self.plain(s)

    def _word(self, w: bytes) -> bytes:
        head = w.rstrip(_TAIL)
        if head and len(head) < len(w) and (head.isalpha() or head.decode("utf-8").isalpha()):
            return self.parts[head.lower()] + self.parts[w[len(head):]]
        return self.parts[w.lower()] if w.isalpha() else self.parts[w]

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, words(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
