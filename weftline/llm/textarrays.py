"""Words of a whole Arrow batch of texts as flat numpy arrays, and Rabin-Karp hashes over them.

A batch's UTF-8 bytes are looked at together: no Python object is made for a word. All hashes are
polynomials modulo 2**64 with an odd (so invertible) base, from prefix sums, and then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
SEGMENT = 1 << 20
_powers: dict[str, np.ndarray] = {}

SPACE_CLASS = np.ones(256, bool)  # [^\x20\x09-\x0D]
SPACE_CLASS[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < size:
        size = max(size, SEGMENT * 2)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for spans in ascending order that don't overlap."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, base + SEGMENT)))
        up, down = _table(int(ends[j - 1] - base) + 1)
        part = data[base : ends[j - 1]].astype(U64)
        part += U64(1)
        part *= up[: len(part)]
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(part, dtype=U64)))
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(WORD_BASE))
        i = j
    return out


class Texts:
    """data: all bytes, each text followed by one space; first: where each text begins in data; starts, ends and
    text: the words' places and the number of the text each belongs to; word_at: where a text's words begin."""

    def __init__(self, column: pa.Array, word_bytes: np.ndarray = SPACE_CLASS, lower: bool = False):
        column = column.cast(pa.large_string())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        if column.null_count:  # a null's slot may hold bytes
            column = column.fill_null("")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.empty(0, np.uint8)
        ends = (offsets[1:] - offsets[0]).astype(np.int64)
        self.data = np.insert(raw, ends, 0x20)
        if lower:
            self.data = LOWER[self.data]
        self.n = n
        self.first = np.concatenate(([0], ends + np.arange(1, n + 1))).astype(np.int64)
        inside = word_bytes[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.starts, self.ends = edges[::2].astype(np.int64), edges[1::2].astype(np.int64)
        self.word_at = np.searchsorted(self.starts, self.first)
        self.n_words = np.diff(self.word_at)
        self.text = np.repeat(np.arange(n), self.n_words)

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sums of a per-byte mark over each text."""
        sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def per_text_words(self, values: np.ndarray) -> np.ndarray:
        """Sums of a per-word value over each text."""
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return sums[self.word_at[1:]] - sums[self.word_at[:-1]]

    def same_text(self, k: int) -> np.ndarray:
        """For each word from which k words could start: whether they stay in one text."""
        return self.text[: len(self.text) - k + 1] == self.text[k - 1 :] if len(self.text) >= k else np.zeros(0, bool)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A rolling hash of every k consecutive words, text boundaries not looked at."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out, power = np.zeros(n, U64), 1
    for j in range(k):
        out += words[j : j + n] * U64(power)
        power = power * WORD_BASE % (1 << 64)
    return mixed(out + U64(k))


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of words[start:end] for spans with ascending starts, which may overlap."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, base + SEGMENT)))
        top = int(ends[i:j].max())
        up, down = _table(top - int(base) + 1)
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(words[base:top] * up[: top - base], dtype=U64)))
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(WORD_BASE))
        i = j
    return out
