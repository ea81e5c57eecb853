"""Vectorised splitting and hashing of words, sentences and shingles over Arrow text buffers."""

from __future__ import annotations

import numpy as np

_SPACES = b" \t\n\v\f\r"
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator, on uint64 arrays."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Odd random weights of a byte's place in its word.
_PLACES = mix(np.arange(1024, dtype=np.uint64)) | np.uint64(1)


def plain_table() -> np.ndarray:
    """Words are runs of anything but ASCII white space; 0 separates."""
    t = np.arange(256, dtype=np.uint8)
    t[t == 0] = 1
    t[list(_SPACES)] = 0
    return t


def folded_table() -> np.ndarray:
    """ASCII letters in lower case, digits and all non-ASCII bytes make words; the rest separates."""
    t = np.zeros(256, np.uint8)
    for c in range(256):
        if chr(c).isascii() and chr(c).isalnum():
            t[c] = ord(chr(c).lower())
        elif c >= 128:
            t[c] = c
    return t


def word_hashes(buf: np.ndarray, offs: np.ndarray, table: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
    """(hash, start byte, row) of each word of rows laid end to end in ``buf``.

    ``prefixes``: also a list of (hash, word) of the words' first bytes, for words longer than that.
    """
    mapped = table[buf]
    is_word = mapped != 0
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    start[heads] = is_word[heads]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts, *[[]][: bool(prefixes)]
    at = np.arange(len(buf), dtype=np.int64)
    place = at - np.maximum.accumulate(np.where(start, at, 0))
    value = (mapped.astype(np.uint64) + np.uint64(1)) * _PLACES[place & 1023]
    far = place >> 10
    if far.any():
        value *= (far.astype(np.uint64) << np.uint64(1)) + np.uint64(1)
    value[~is_word] = 0
    h = mix(np.add.reduceat(value, starts))
    row = np.searchsorted(offs, starts, "right") - 1
    if not prefixes:
        return h, starts, row
    length = np.add.reduceat(is_word.astype(np.int64), starts)
    cut = []
    for k in prefixes:
        longer = np.flatnonzero(length > k)
        total = np.zeros(len(longer), np.uint64)
        for j in range(k):
            total += value[starts[longer] + j]
        cut.append((mix(total + np.uint64(k)), longer))
    return h, starts, row, cut


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``width`` words; a row with fewer words has one shingle of all of them."""
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    total = np.zeros(len(h), np.uint64)
    weights = mix(np.arange(77, 77 + width, dtype=np.uint64)) | np.uint64(1)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    rows = np.concatenate((row, np.full(width, -1)))
    for j in range(width):
        same = rows[j : j + len(h)] == row
        total += np.where(same, padded[j : j + len(h)], np.uint64(0)) * weights[j]
    place = np.arange(len(h)) - first[row]
    keep = (place + width <= count[row]) | ((place == 0) & (count[row] < width))
    return mix(total[keep]), row[keep]


def sentence_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First byte of each sentence; one ends after ``.``, ``!``, ``?`` or a line feed, or with its row."""
    ends = np.isin(buf, np.frombuffer(b".!?\n", np.uint8))
    first = np.zeros(len(buf) + 1, bool)
    first[1:][ends] = True
    first[offs[:-1]] = True
    first = first[: len(buf)]
    # a mark straight after another opens no sentence of its own
    first[1:] &= ~(ends[1:] & ends[:-1])
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] = True
    return np.flatnonzero(first)
