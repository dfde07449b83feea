"""Statistics of texts that several operators use, computed on UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: A class for each byte. Bytes of characters beyond ASCII count as letters (the first) or not at all (the rest).
OTHER, LOWER, UPPER, DIGIT, SYMBOL, PIPE, BANG, SPACE, REST = range(9)
CLASSES = 9
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = LOWER
_CLASS[ord("A") : ord("Z") + 1] = UPPER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[[ord(c) for c in "#*$%&<>"]] = SYMBOL
_CLASS[ord("|")] = PIPE
_CLASS[ord("!")] = BANG
_CLASS[[32, *range(9, 14)]] = SPACE
_CLASS[0x80:0xC0] = REST
_CLASS[0xC0:] = LOWER


def classes(text: bytes) -> np.ndarray:
    """The class of each byte."""
    return _CLASS[np.frombuffer(text, np.uint8)]


def repeated_words(words: list[bytes]) -> np.ndarray:
    """For each word, whether it is in a window of three words that the text has twice or more."""
    n = len(words)
    covered = np.zeros(n, bool)
    if n < 4:
        return covered
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 2_000_000:  # keep the next product within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(known) + ids[2:]
    in_order = np.sort(keys)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if len(twice):
        at = np.flatnonzero(np.isin(keys, twice))
        for k in range(3):
            covered[at + k] = True
    return covered
