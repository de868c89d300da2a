"""Counts over one whole text that several operators use."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np

from .common import words

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"


def word_ids(ws: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words by first occurrence, and every word's number among them."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    numbers = np.fromiter(map(ids.__getitem__, ws), np.int64, len(ws))
    return list(ids), numbers


def repeat_words(ids: np.ndarray, n: int = 3) -> int:
    """Words inside n-word windows that occur twice or more, first ones included."""
    if len(ids) <= n:
        return 0
    base, windows = int(ids.max()) + 1, len(ids) - n + 1
    key, size = ids[:windows].copy(), base
    for i in range(1, n):
        if size * base >= 2 ** 62:  # renumber before the product leaves 64 bits
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key, size = key * base + ids[i: windows + i], size * base
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(key, again))
    found = np.zeros(len(ids), bool)
    for i in range(n):
        found[at + i] = True
    return int(found.sum())


def word_chars(text: str) -> int:
    """Code points inside words."""
    return len(text) - sum(map(text.count, _SPACE))


def n_symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def has_word(line: str) -> bool:
    return bool(line.strip(_SPACE))


def dup_lines(lines: list[str]) -> int:
    """Lines with a word that equal an earlier line."""
    with_word = [x for x in lines if has_word(x)]
    return len(with_word) - len(set(with_word))


def stats(text: str) -> dict[str, int]:
    """Counts and the numbered words of a whole text."""
    ws = words(text)
    distinct, ids = word_ids(ws)
    return {"distinct": distinct, "ids": ids, "n_words": len(ws), "word_chars": word_chars(text), "n_symbols": n_symbols(text),
            "n_dup_lines": dup_lines(text.split("\n")), "n_repeat_words": repeat_words(ids)}
