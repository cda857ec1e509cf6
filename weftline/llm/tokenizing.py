"""Token ids of whole texts by the tokenizers library, without paying for a word twice.

The tokenizers used here split a text before they look up ids, and always do so where a white-space character follows
another character and where an ASCII sign follows a letter. So a text is cut there, the library encodes each distinct
piece once, and the ids of a text are its pieces' ids in order. Pieces of a whole Arrow batch are found, hashed and looked
up as numpy arrays (64 bits of hash and the length name a piece); what is known is kept in tables of a fixed size. Texts
with white space or control characters beyond blank, tab, CR and LF, and texts that hold the string of an added token
(which the library finds before it splits), are given to the library whole, since the rule isn't sure for them.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from weftline.llm.textarrays import U64, Texts, span_hashes

SLOTS, POOL_IDS = 1 << 21, 1 << 24
WHITE = np.isin(np.arange(256), [0x09, 0x0A, 0x0D, 0x20])
CONTROL = (np.arange(256) < 0x20) & ~WHITE | (np.arange(256) == 0x7F)
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
SIGN = np.zeros(256, bool)
SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: UTF-8 forms of white space and invisible characters beyond ASCII: lead bytes, then the range of the last byte.
ODD = (((0xC2,), 0x85, 0x85), ((0xC2,), 0xA0, 0xA0), ((0xE1, 0x9A), 0x80, 0x80), ((0xE1, 0xA0), 0x8E, 0x8E), ((0xE2, 0x80), 0x80, 0x8F), ((0xE2, 0x80), 0xA8, 0xAF), ((0xE2, 0x81), 0x9F, 0xA9), ((0xE3, 0x80), 0x80, 0x80), ((0xEF, 0xBB), 0xBF, 0xBF))


def _odd(data: np.ndarray) -> np.ndarray:
    """Marks of bytes that make a text unsure."""
    marks = CONTROL[data]
    if (data >= 0xC2).any():
        for lead, low, high in ODD:
            k = len(lead)
            hit = (data[k:] >= low) & (data[k:] <= high)
            for j, byte in enumerate(lead):
                hit &= data[j : len(data) - k + j] == byte
            marks[k:] |= hit
    return marks


class Encoder:
    """ids(column) gives all ids of a batch in ``dtype`` (16 bits where the vocabulary allows it) and where each text's
    begin. A null text is empty."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.names, self.sizes = np.zeros(SLOTS, U64), np.full(SLOTS, -1, np.int32)
        self.places, self.counts = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _library(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _with_added(self, t: Texts) -> np.ndarray:
        """By text: whether it holds an added token's string."""
        found, whole = np.zeros(t.n, bool), t.data.tobytes()
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                i = int(np.searchsorted(t.first, at, side="right")) - 1
                found[i] |= at + len(token) < t.first[i + 1]
                at = whole.find(token, int(t.first[i + 1]) if found[i] else at + 1)
        return found

    def _store(self, got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts in the pool."""
        counts = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter((i for x in got for i in x), self.dtype, int(counts.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        places = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        return places.astype(np.int32), counts

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.used > POOL_IDS:
            self.sizes[:] = -1
            self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        t = Texts(column)
        data, last = t.data, t.first[1:] - 1
        white = WHITE[data]
        begins = white.copy()
        begins[1:] &= ~white[:-1]
        letter = LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begins[1:] |= SIGN[data[1:]] & letter[:-1]
        begins[t.first[:-1]] = True
        begins[last] = True  # the blank after each text: a piece that is dropped
        unsure = (t.per_text(_odd(data)) > 0) | self._with_added(t)
        starts = np.flatnonzero(begins)
        ends = np.concatenate((starts[1:], [len(data)]))
        text = np.searchsorted(t.first, starts, side="right") - 1
        own = starts != last[text] if len(starts) else np.zeros(0, bool)
        if unsure.any():
            own &= ~unsure[text]
        starts, ends, text = starts[own], ends[own], text[own]
        names, sizes = span_hashes(data, starts, ends), (ends - starts).astype(np.int32)

        slot = (names & U64(SLOTS - 1)).astype(np.int64)
        other = ((names >> U64(40)) & U64(SLOTS - 1)).astype(np.int64)
        slot = np.where((self.names[slot] == names) & (self.sizes[slot] == sizes), slot, other)
        known = (self.names[slot] == names) & (self.sizes[slot] == sizes)
        places, counts = self.places[slot], self.counts[slot]
        if not known.all():
            missed = np.flatnonzero(~known)
            _, first, back = np.unique(names[missed] ^ sizes[missed].astype(U64), return_index=True, return_inverse=True)
            at = missed[first]
            whole = data.tobytes()
            new_places, new_counts = self._store(self._library([whole[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            places[missed], counts[missed] = new_places[back], new_counts[back]
            free = self.sizes[(names[at] & U64(SLOTS - 1)).astype(np.int64)] < 0
            to = np.where(free, (names[at] & U64(SLOTS - 1)).astype(np.int64), other[at])
            self.names[to], self.sizes[to], self.places[to], self.counts[to] = names[at], sizes[at], new_places, new_counts
        if unsure.any():
            odd = np.flatnonzero(unsure)
            odd_places, odd_counts = self._store(self._library([data[t.first[i] : last[i]].tobytes().decode() for i in odd]))
            order = np.argsort(np.concatenate((text, odd)), kind="stable")
            text, places, counts = np.concatenate((text, odd))[order], np.concatenate((places, odd_places))[order], np.concatenate((counts, odd_counts))[order]
        upto = np.cumsum(counts, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.arange(total) + np.repeat(places - (upto - counts), counts)]
        per_text = np.bincount(text, counts, minlength=t.n).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_text)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file in a Python worker."""
    return Encoder(path)
