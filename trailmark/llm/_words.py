"""Hashes of words and word shingles of many texts at once, in numpy over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from trailmark.llm._arrow import byte_view

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_U = np.uint64

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True

_punct = _space.copy()
_punct[[i for i in range(128) if not chr(i).isalnum()]] = True

_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(max(n, 1 << 16), base, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the splitmix64 finish)."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of an Arrow text column, A-Z in lower case.

    row: the text of each word; start, end: its bytes in `data`; hashes: 64-bit polynomial hashes of its bytes, mixed.
    With `plain`, all ASCII characters but letters and digits part words too.
    """

    def __init__(self, texts: pa.Array, plain: bool = False):
        raw, at = byte_view(texts)
        self.rows, self.data = len(texts), _lower[raw]
        blank = np.ones(len(raw) + 1, bool)
        blank[:-1] = (_punct if plain else _space)[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[at] = True
        before = np.empty(len(raw) + 1, bool)
        before[0], before[1:] = True, blank[:-1]
        self.start = np.flatnonzero(~blank & (before | first))
        # A word ends before a blank, before the next text, and at the end.
        ends = np.flatnonzero((blank | first) & ~before)
        self.end = ends
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows)

    def hashes(self) -> np.ndarray:
        power, inverse = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of `size` words, repeats included; a text with fewer words is one run."""
        words, n = self.hashes(), len(self.start)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        factor = [_U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(size)]
        padded = np.concatenate([words, np.zeros(size - 1, _U)])
        runs = sum((padded[k : k + n] * factor[k] for k in range(1, size)), padded[:n] * factor[0])
        last = np.cumsum(self.counts)
        whole = np.arange(n) + size <= last[self.row]
        row, out = self.row[whole], runs[whole]
        few = np.flatnonzero((self.counts > 0) & (self.counts < size))
        if len(few):
            starts = last[few] - self.counts[few]
            total = np.zeros(len(few), _U)
            for k in range(size - 1):
                inside = k < self.counts[few]
                total[inside] += words[starts[inside] + k] * factor[k]
            row, out = np.concatenate([row, few]), np.concatenate([out, total + self.counts[few].astype(_U)])
        return row, mix(out, 1)

    def shingle_sets(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """shingles() without repeats, by text and then hash."""
        row, out = self.shingles(size)
        order = np.lexsort((out, row))
        row, out = row[order], out[order]
        new = np.ones(len(out), bool)
        new[1:] = (row[1:] != row[:-1]) | (out[1:] != out[:-1])
        return row[new], out[new]
