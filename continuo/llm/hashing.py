"""Words and word-sequence hashes of many texts at once, as numpy arrays over their UTF-8 bytes.

A word's hash is a polynomial of its bytes modulo 2**64, finalised with its length; a sequence's
hash is a polynomial of word hashes. Prefix sums give any span's hash in constant time.
"""

from __future__ import annotations

import numpy as np

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F | 1)
KEPT_POWERS = 1 << 19
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Separators: space and the ASCII controls 09 to 0D.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, every other byte unchanged.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n at least."""
    got = _POWERS.get(int(base))
    if got is None or len(got[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        tables = []
        for b in (base, inverse):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        got = (tables[0], tables[1])
        if size <= KEPT_POWERS:  # those for a very long text go with it
            _POWERS[int(base)] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of a slice of texts: byte spans, hashes and each document's range of words."""

    def __init__(self, text_array, lower: bool = False):
        offsets = np.frombuffer(text_array.buffers()[1], dtype=np.int32)
        offsets = offsets[text_array.offset : text_array.offset + len(text_array) + 1].astype(np.int64)
        first, last = int(offsets[0]), int(offsets[-1])
        buffer = text_array.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8)[first:last] if buffer is not None and last > first else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        self.offsets = offsets - first
        inside = ~SPACES[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = np.flatnonzero(np.diff(self.offsets) > 0)
        head, tail = self.offsets[full], self.offsets[full + 1] - 1
        begins[head] = inside[head]
        ends[tail] = inside[tail]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # document d: words first[d] to first[d + 1]
        self.counts = np.diff(self.first)
        power, inverse = powers(_BYTE_BASE, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=sums[1:])
        length = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + length * np.uint64(0xD6E8FEB86659FD93))
        power, self._inverse = powers(_WORD_BASE, len(self.hashes) + 1)
        self._sums = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
        np.cumsum(self.hashes * power[: len(self.hashes)], out=self._sums[1:])

    def spans(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the word sequences that begin at words ``start`` and have ``length`` words."""
        stop = start + length
        raw = (self._sums[stop] - self._sums[start]) * self._inverse[start]
        return mix(raw + np.asarray(length, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def set_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document's shingle hashes, one after another, and where each document's begin.

    A document with fewer than ``size`` words, but not none, has its whole sequence as one shingle.
    """
    short = (words.counts > 0) & (words.counts < size)
    number = np.where(short, 1, np.maximum(words.counts - size + 1, 0))
    begin = np.concatenate([[0], np.cumsum(number)])
    start = np.arange(begin[-1]) - np.repeat(begin[:-1] - words.first[:-1], number)
    length = np.repeat(np.where(short, words.counts, size), number)
    return words.spans(start, length), begin
