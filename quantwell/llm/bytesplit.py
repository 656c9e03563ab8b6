"""Splits UTF-8 bytes into tokenizer words with array operations.

It covers texts of ASCII and of the letters of U+00C0 to U+00FF without marks that a
tokenizer treats apart; `plain_documents` tells which texts these are. The others go
through the tokenizer library itself.
"""

from __future__ import annotations

import numpy as np

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3

_KIND = np.zeros(256, np.uint8)
for _a, _b in (("A", "Z"), ("a", "z")):
    _KIND[ord(_a) : ord(_b) + 1] = LETTER
_KIND[0x80:0xC0] = LETTER
_KIND[0xC3] = LETTER
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[9:14] = SPACE
_KIND[32] = SPACE

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def plain_documents(data: np.ndarray, offsets: np.ndarray, marker: bytes = b"<|") -> np.ndarray:
    """For each document, whether `word_starts` covers it. `marker` begins special tokens."""
    bad = np.zeros(0, np.int64)
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        value = data[high]
        before = np.where(high > 0, data[np.maximum(high, 1) - 1], 0)
        fine = (value == 0xC3) | ((before == 0xC3) & (value < 0xC0) & (value != 0x97) & (value != 0xB7))
        bad = high[~fine]
    if len(marker) == 2 and len(data) > 1:
        bad = np.concatenate([bad, np.flatnonzero((data[:-1] == marker[0]) & (data[1:] == marker[1]))])
    plain = np.ones(len(offsets) - 1, bool)
    if len(bad):
        plain[np.searchsorted(offsets, bad, "right") - 1] = False
    return plain


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of plain texts."""
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = lead[(data[lead] < 0x9F) & (data[lead] != 0x97)]
    out[upper] += 32
    return out


def _contractions(data: np.ndarray, begins: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where 's 't 'm 'd 're 've 'll begin, and how long they are."""
    at = np.flatnonzero(begins & (data == 39))
    if not len(at):
        return at, at
    end = offsets[np.searchsorted(offsets, at, "right")]
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    one, two = padded[at + 1].copy(), padded[at + 2].copy()
    one[at + 1 >= end] = 0
    two[at + 2 >= end] = 0
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(short, 2, np.where(long, 3, 0))
    return at[size > 0], size[size > 0]


def word_starts(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> np.ndarray:
    """Offsets at which words begin, document starts included.

    spaced: a space belongs to the word it precedes, as byte-level tokenizers have it;
    otherwise white space stands apart and every digit is a word.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run
    if spaced:
        inner = np.flatnonzero(run & ~first & (kind != SPACE))
        after = inner[kind[inner - 1] == SPACE]
        start[after - 1] = True
        start[after[data[after - 1] == 32]] = False
    else:
        start |= kind == DIGIT
    at, size = _contractions(data, start, offsets)
    if len(at):
        start[at + 1] = False
        stop = at + size
        stop = stop[stop < offsets[np.searchsorted(offsets, at, "right")]]
        start[stop] = True
    return np.flatnonzero(start)


def is_space(data: np.ndarray) -> np.ndarray:
    return _KIND[data] == SPACE
