"""Word shingles of many texts at once, as 64-bit hashes in flat numpy arrays.

A word's hash is a difference of prefix sums of byte values times powers of an odd number, brought to
a common power; a shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_PRIME = 0x9E3779B97F4A7C15 | 1
_SPACES = [0x20, *range(0x09, 0x0E)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A value for each byte; capital letters A-Z share that of their small ones, white space has none.
BYTE_VALUE = _mix(np.arange(1, 257, dtype=np.uint64))
BYTE_VALUE[0x41:0x5B] = BYTE_VALUE[0x61:0x7B]
BYTE_VALUE[_SPACES] = 0
IN_WORD = np.ones(256, bool)
IN_WORD[_SPACES] = False
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Keeps the tables of powers, which grow to the longest input so far."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.up = self.down = np.zeros(0, np.uint64)

    def word_hashes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and how many words each row has."""
        inside = IN_WORD[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
        begin[firsts] = inside[firsts]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        lasts = firsts_end = bounds[1:][bounds[:-1] < bounds[1:]] - 1
        finish[lasts] = inside[firsts_end]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        if len(self.up) < len(data) + 1:
            self.up, self.down = _powers(_PRIME, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * self.up[: len(data)], out=total[1:])
        hashed = _mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        return hashed, np.diff(np.searchsorted(starts, bounds))

    def sets(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes of each row, ascending, one row after another, and how many each row has.

        A row with fewer words than a shingle has one shingle, all its words; one without words has none.
        """
        words, counts = self.word_hashes(data, bounds)
        ends = np.cumsum(counts)
        row = np.repeat(np.arange(len(counts)), counts)
        left = ends[row] - np.arange(len(words))  # words from here to the row's end
        whole = left >= self.words
        at = np.flatnonzero(whole | ((counts[row] < self.words) & (left == counts[row])))
        value = np.zeros(len(at), np.uint64)
        full = whole[at]
        for some, there in ((full, None), (~full, left[at[~full]])):
            place, mixed = at[some], np.zeros(int(some.sum()), np.uint64)
            for k in range(self.words):
                if there is None:
                    mixed = _mix(mixed * np.uint64(0x100000001B3) + words[place + k])
                else:
                    mixed = np.where(k < there, _mix(mixed * np.uint64(0x100000001B3) + words[np.minimum(place + k, len(words) - 1)]), mixed)
            value[some] = mixed
        owner = row[at]
        cuts = np.searchsorted(owner, np.arange(len(counts) + 1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # a row at a time: far faster than by two keys
            if hi - lo > 1:
                value[lo:hi].sort()
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        return value[fresh], np.bincount(owner[fresh], minlength=len(counts))
