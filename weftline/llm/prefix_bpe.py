"""Byte-pair encoding by dynamic programming over prefixes, and decoding, for tokenizer files with a byte-level BPE model.

In the encoding of a string every prefix that the tokens cut off is encoded the same way as when it stands alone. So each
prefix has one last token: of the tokens that the prefix ends with, the one that is compatible with the last token of what
is left before it. The tokens that end a prefix are found with a suffix automaton of the whole vocabulary, longest first;
two tokens are compatible if no merge across their border comes before the merges that build them. Back-pointers from the
whole string give its ids: no merge is ever carried out.

The file's normaliser and pre-tokeniser are the library's own; a text is cut where white space (blank, tab, LF, VT, FF, CR)
follows something else, which these files' splits never cross, and pieces met before are looked up. Strings of
added tokens are found before anything else, as the library does.

Defined results: a null text is empty, and has no ids; a text of any length is encoded whole; rows are independent of each
other, so repeated rows and ids and null ids give a row each; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm.common import bounded_batches, own_columns, table

KNOWN = 1 << 19
MARK = 0xE000  # a last character of a word is another symbol than the same character elsewhere: moved to private characters
NEVER = 1 << 60
WHITE, RUN = " \t\n\v\f\r", re.compile(r"[ \t\n\v\f\r]+")
PIECE = re.compile(r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+")
#: White space, separators and invisible characters beyond those of PIECE: texts that hold one aren't cut.
UNSURE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")


class Matches:
    """A suffix automaton of many strings. After each symbol, the strings that what was read ends with are at hand, longest first."""

    def __init__(self, strings: list[str]):
        self.next, self.link, self.length = [{}], [-1], [0]
        ends = [(self._add(s), s) for s in strings]
        self.string: list[str | None] = [None] * len(self.length)
        for state, s in ends:
            self.string[state] = s
        self.shorter = [0] * len(self.length)  # the longest string that is a proper suffix of a state's strings, or the root
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            above = self.link[state]
            self.shorter[state] = above if self.string[above] is not None else self.shorter[above]

    def _state(self, length: int, steps: dict, link: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _add(self, string: str) -> int:
        steps, link, length, at = self.next, self.link, self.length, 0
        for c in string:
            there = steps[at].get(c)
            if there is not None:
                at = there if length[there] == length[at] + 1 else self._split(at, there, c)
                continue
            new, p = self._state(length[at] + 1, {}, 0), at
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            at = new
        return at

    def _split(self, p: int, q: int, c: str) -> int:
        """A state of its own for the strings of q that come from p."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy


class Merges:
    """The merges of a vocabulary: when a token is made, and whether two tokens stay apart side by side."""

    def __init__(self, pairs: list[tuple[str, str]], symbols: set[str]):
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.apart: dict[tuple[str, str], bool] = {}
        self.sides: tuple[dict, dict] = ({}, {})
        self.parts: dict[str, tuple[str, str]] = {}
        self.born = dict.fromkeys(symbols, -1)
        for i, (a, b) in enumerate(pairs):
            if a + b in self.born or not (self.born.get(a, NEVER) < i and self.born.get(b, NEVER) < i):
                raise ValueError("merges must name tokens made before, and make each token once")
            self.parts[a + b], self.born[a + b] = (a, b), i
        self.made = symbols | {t for t, p in self.parts.items() if self.crossing(*p) == self.born[t]}  # others never come about

    def _side(self, token: str, which: int) -> list[tuple[str, int, int]]:
        """What stands at one side of a token while it is built: each part, from when to when."""
        known = self.sides[which].get(token)
        if known is not None:
            return known
        part, found, until = token, [], NEVER
        while part in self.parts:
            found.append((part, self.born[part], until))
            until, part = self.born[part], self.parts[part][which]
        self.sides[which][token] = found = [*found, (part, -1, until)]
        return found

    def crossing(self, a: str, b: str) -> int:
        """The rank of the first merge across the border of a and b, NEVER if there is none. Of equal merges the leftmost comes first:
        one inside a before one across, that before one inside b."""
        first = NEVER
        for x, x_born, x_until in self._side(a, 1):
            for y, y_born, y_until in self._side(b, 0):
                at = self.rank.get((x, y))
                if at is not None and at < first and x_born < at < x_until and y_born < at <= y_until:
                    first = at
        return first

    def compatible(self, a: str, b: str) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > KNOWN:
                self.apart.clear()
            known = self.apart[a, b] = self.crossing(a, b) == NEVER
        return known


class Codec:
    """encode(text) and decode(ids) as the file's tokenizer has them, without special tokens of its own making."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or "ByteLevel" not in json.dumps(spec["pre_tokenizer"]):
            raise ValueError("not a plain byte-level BPE model")
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.suffix = model.get("end_of_word_suffix") or ""
        tokens = {self._symbols(t): i for t, i in model["vocab"].items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        pairs = [(a, self._symbols(b)) for a, b in merges]
        self.merges = Merges(pairs, {t for t in tokens if len(t) == 1})
        self.id = {t: i for t, i in tokens.items() if t in self.merges.made}
        self.matches = Matches(list(self.id))
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.names = {i: t for t, i in (model["vocab"] | added).items()}
        kind = (spec["decoder"] or {"type": None})["type"]
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoding by {kind}")
        self.bytes = {c: b for b, c in enumerate(byte_characters())} if kind else None
        self.words: dict[str, bytes] = {}  # their ids as 32-bit integers
        self.pieces: dict[str, bytes] = {}

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + MARK)
        return token

    def word(self, word: str) -> bytes:
        """The ids of one pre-token, by its prefixes, as 32-bit integers."""
        known = self.words.get(word)
        if known is not None:
            return known
        symbols = word[:-1] + chr(ord(word[-1]) + MARK) if self.suffix else word
        m, compatible, apart = self.matches, self.merges.compatible, self.merges.apart
        steps, link, length, string, shorter = m.next, m.link, m.length, m.string, m.shorter
        last = [""] * (len(symbols) + 1)
        state = read = 0
        for i, c in enumerate(symbols, 1):
            to = steps[state].get(c)
            while to is None:
                state = link[state]
                if state < 0:
                    raise ValueError(f"no token for {c!r}")
                read, to = length[state], steps[state].get(c)
            state, read = to, read + 1
            found = state if read == length[state] and string[state] is not None else shorter[state]
            n = length[found]
            while n < i:
                pair = (last[i - n], string[found])
                apart_ = apart.get(pair)
                if compatible(*pair) if apart_ is None else apart_:
                    break
                found = shorter[found]
                n = length[found]
            last[i] = string[found]
        ids, i = [], len(symbols)
        while i:
            ids.append(self.id[last[i]])
            i -= len(last[i])
        if len(self.words) > KNOWN:
            self.words.clear()
        got = self.words[word] = array("i", reversed(ids)).tobytes()
        return got

    def _plain(self, text: str) -> bytes:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return b"".join([self.word(word) for word, _ in self.pre_tokenizer.pre_tokenize_str(text)])

    def _cut(self, text: str) -> bytes:
        if UNSURE.search(text):
            return self._plain(text)
        parts, pieces = PIECE.findall(text), self.pieces
        if len(pieces) > KNOWN:
            pieces.clear()
        new = list(set(parts).difference(pieces))
        if new:
            self._learn([p for p in new if p[0] in WHITE and p[-1] not in WHITE])
            pieces.update((p, self._plain(p)) for p in new if p not in pieces)
        return b"".join(map(pieces.__getitem__, parts))

    def _learn(self, new: list[str]) -> None:
        """Pieces that begin with white space and hold no other are normalised and split as one text, in which each begins at white space."""
        text = "".join(new)
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        ends = [m.start() for m in RUN.finditer(text)][1:]
        if len(ends) + 1 != len(new):  # a normaliser that makes or takes white space
            return
        found: list[list[bytes]] = [[] for _ in new]
        k, end = 0, ends[0] if ends else len(text)
        for word, (start, _) in self.pre_tokenizer.pre_tokenize_str(text):
            while start >= end:
                k += 1
                end = ends[k] if k < len(ends) else len(text)
            found[k].append(self.word(word))
        self.pieces.update(zip(new, map(b"".join, found), strict=True))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit integers."""
        if self.split is None or not self.split.search(text):
            return self._cut(text)
        return b"".join([array("i", [self.added[part]]).tobytes() if k % 2 else self._cut(part) for k, part in enumerate(self.split.split(text))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Names of ids: bytes put together where the file asks for that, else joined by blanks. Ids without a name are left out."""
        try:
            named = list(map(self.names.__getitem__, ids))
        except KeyError:
            named = [self.names[i] for i in ids if i in self.names]
        if self.bytes is None:
            return " ".join(named)
        parts = [bytes(self.bytes[c] for c in t) if all(c in self.bytes for c in t) else t.encode() for t in named]
        return b"".join(parts).decode("utf-8", "replace")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each file in a Python worker."""
    return Codec(path)


def _lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _mapped(rows: DataFrame, schema: str, make: Callable[[list], list[pa.Array]]) -> DataFrame:
    """A row for each row: the first column, and what make gives for the values of the second."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *make(b.column(1).to_pylist())], [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every text."""
    return _mapped(own_columns(docs, "doc_id", "text"), "doc_id long, ids array<int>", lambda texts: [_lists([codec(path).encode_bytes(t or "") for t in texts])])


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are none."""
    return _mapped(own_columns(rows, "doc_id", "ids"), "doc_id long, text string", lambda lists: [pa.array([codec(path).decode(ids or []) for ids in lists], pa.string())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every text, and the text that they decode to."""

    def make(texts: list) -> list[pa.Array]:
        found = [codec(path).encode_bytes(t or "") for t in texts]
        return [_lists(found), pa.array([codec(path).decode(np.frombuffer(ids, np.int32).tolist()) for ids in found], pa.string())]

    return _mapped(own_columns(docs, "doc_id", "text"), "doc_id long, ids array<int>, text string", make)


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents"), os.fspath(public_tokenizers.path("word_bpe_49k.json")))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
