"""Tokens of two vocabularies over the same bytes: groups between shared cuts, and the tokens that correspond.

A text with a blank before it is encoded by a byte-level BPE (A) and a piece model (B) that adds that blank. Both token
lists cover the same bytes, so where an A token and a B token end at one byte both can be cut. Cuts are found by divide and
conquer: in a stretch between two shared cuts a common end near its middle is looked for by bisecting from one list into
the other, to the right and then to the left; both halves are dealt with in the same way, and a stretch without one is a
group. All stretches of an Arrow batch are halved together. Each A token of a group is linked to each B token of it.

How many texts link two ids is counted over all of them. Pairs whose share of all links is above 1 in HEAD_PAIRS (so at
most HEAD_PAIRS of them) are joined by broadcast, the long tail by a shuffle, where no pair has a greater share than that.

Defined results: null and empty texts, and texts that one of the vocabularies doesn't reproduce byte by byte, have no tokens
and zeros everywhere; repeated rows are documents of their own and count each; null ids are ids like others; texts of any
length are encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from weftline.llm.common import bounded_batches, own_columns, staged, table
from weftline.llm.prefix_bpe import PIECE, UNSURE, byte_characters

KNOWN, HEAD_PAIRS, WIDE, CHARACTERS = 1 << 18, 100_000, 64, 1 << 18
WHOLE = re.compile(r"[\r\v\f]")
LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


class ByteSide:
    """A byte-level BPE file; strings of special tokens are plain text. names: the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.names = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.names[i] = bytes([byte[c] for c in token])
        self.sizes = np.array([len(x) for x in self.names], np.int64)

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


class PieceSide:
    """A piece model with byte fallback that puts a blank before a text. A part that begins with a blank goes without it to the
    library, which adds it; of a part that begins with a tab or line feed the added blank is dropped. So the model's own pieces
    must not hold those, or a blank after something else."""

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\u2581" in p.lstrip("\u2581") or any(c in p for c in " \t\n") for p in pieces):
            raise ValueError("pieces hold blanks after other characters, tabs or line feeds")
        self.names = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array([len(x) for x in self.names], np.int64)
        self.blank = self.model.piece_to_id("\u2581")

    def encode(self, parts: list[str]) -> list[list[int]]:
        got = self.model.encode([p.removeprefix(" ") for p in parts], num_threads=1)
        return [ids[1:] if p[0] != " " else ids or [self.blank] for p, ids in zip(parts, got, strict=True)]


class Both:
    """ids of texts by both vocabularies. A text is cut where white space follows something else, which neither crosses, and parts met
    before are looked up. Texts with white space other than blanks, tabs and line feeds aren't cut: pieces may join it to others."""

    def __init__(self, a: ByteSide, b: PieceSide):
        self.sides = (a, b)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.odd: set[str] = set()  # parts that one side doesn't reproduce

    def _learn(self, parts: list[str]) -> None:
        texts = [p.encode() for p in parts]
        sizes, whole, found = np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts), []
        for side in self.sides:
            got = side.encode(parts)
            n = np.fromiter(map(len, got), np.int64, len(got))
            flat = list(chain.from_iterable(got))
            data, ends = np.array(flat, "<i4").tobytes(), (4 * np.cumsum(n)).tolist()
            found.append([data[s:e] for s, e in zip([0, *ends], ends, strict=False)])
            upto = np.concatenate(([0], np.cumsum(side.sizes[np.array(flat, np.int64)])))[np.concatenate(([0], np.cumsum(n)))]
            if not np.array_equal(np.diff(upto), sizes) or b"".join([side.names[i] for i in flat]) != whole:
                self.odd.update(p for p, t, ids in zip(parts, texts, got, strict=True) if b"".join([side.names[i] for i in ids]) != t)
        self.known.update(zip(parts, zip(*found, strict=True), strict=True))

    def ids(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text its ids by both sides as 32-bit integers; none at all if one side doesn't give the text's bytes back."""
        cut = [[t] if UNSURE.search(t) or WHOLE.search(t) else PIECE.findall(t) for t in texts]
        distinct = set().union(*cut)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            self.odd.clear()
            new = distinct
        if new:
            self._learn(list(new))
        out = []
        for parts in cut:
            if self.odd and not self.odd.isdisjoint(parts) and not self._same(parts):
                out.append((b"", b""))
                continue
            pairs = list(map(self.known.__getitem__, parts))
            out.append((b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])))
        return out

    def _same(self, parts: list[str]) -> bool:
        for k, side in enumerate(self.sides):
            ids = np.frombuffer(b"".join([self.known[p][k] for p in parts]), "<i4").tolist()
            if b"".join([side.names[i] for i in ids]) != "".join(parts).encode():
                return False
        return True


@lru_cache(maxsize=2)
def both(a: str, b: str) -> Both:
    """One for each two files in a Python worker."""
    return Both(ByteSide(a), PieceSide(b))


def shared_cuts(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of all values that both hold. a and b ascend; from_a and from_b: places of known common values, the first
    and the last value among them. Stretches between common values are halved until none is left."""
    cuts = [(from_a, from_b)]
    low_a, high_a, low_b, high_b = from_a[:-1], from_a[1:], from_b[:-1], from_b[1:]
    while len(low_a):
        open_ = (high_a - low_a > 1) & (high_b - low_b > 1)
        low_a, high_a, low_b, high_b = low_a[open_], high_a[open_], low_b[open_], high_b[open_]
        middle = (low_a + high_a) >> 1
        i, j = _next_common(a, b, middle)
        right = i < high_a
        left = ~right
        i[left], j[left] = _last_common(a, b, middle[left] - 1)
        cut = i > low_a
        cuts.append((i[cut], j[cut]))
        again = cut & right  # beyond a cut found to the left nothing is common
        low_a, high_a = np.concatenate((low_a[cut], i[again])), np.concatenate((i[cut], high_a[again]))
        low_b, high_b = np.concatenate((low_b[cut], j[again])), np.concatenate((j[cut], high_b[again]))
    at_a, at_b = (np.concatenate(x) for x in zip(*cuts, strict=True))
    return np.sort(at_a), np.sort(at_b)


def _next_common(a: np.ndarray, b: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first common value at or after a[i], by bisecting in turns."""
    i, j = i.copy(), np.searchsorted(b, a[i])
    todo = np.flatnonzero(b[j] != a[i])
    while len(todo):
        i[todo] = np.searchsorted(a, b[j[todo]])
        j[todo] = np.searchsorted(b, a[i[todo]])
        todo = todo[b[j[todo]] != a[i[todo]]]
    return i, j


def _last_common(a: np.ndarray, b: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last common value at or before a[i]."""
    i, j = i.copy(), np.searchsorted(b, a[i], side="right") - 1
    todo = np.flatnonzero(b[j] != a[i])
    while len(todo):
        i[todo] = np.searchsorted(a, b[j[todo]], side="right") - 1
        j[todo] = np.searchsorted(b, a[i[todo]], side="right") - 1
        todo = todo[b[j[todo]] != a[i[todo]]]
    return i, j


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every span, one after the other."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


def _written(ids: np.ndarray, ends: np.ndarray, firsts: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each followed by its end character (0: none), and where the text of each stretch that begins at ``firsts`` begins."""
    table = np.concatenate((digits[ids], ends[:, None]), axis=1)
    shown = table != 0
    upto = np.concatenate(([0], np.cumsum(shown.sum(axis=1))))
    return table[shown], upto[firsts]


@lru_cache(maxsize=1)
def _digits(n: int) -> np.ndarray:
    width = len(str(n))
    return np.array([list(str(i).encode().rjust(width, b"\0")) for i in range(n)], np.uint8)


def aligned_batch(ids: list, texts: list[str | None], coders: Both) -> pa.RecordBatch:
    """A row for each text: doc_id, n_a, n_b, n_groups, n_links, groups (a1,a2|b1;a3|b2 in order), links (each pair of ids with its number)."""
    a, b = coders.sides
    found = coders.ids([" " + t if t else "" for t in texts])
    n_a, n_b = [np.array([len(x[k]) // 4 for x in found], np.int64) for k in (0, 1)]
    flat_a, flat_b = [np.frombuffer(b"".join([x[k] for x in found]), "<i4") for k in (0, 1)]
    doc_a, doc_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
    ends_a, ends_b = [np.concatenate(([0], np.cumsum(side.sizes[x]))) for side, x in ((a, flat_a), (b, flat_b))]
    own = np.append(True, n_a > 0)
    cut_a, cut_b = shared_cuts(ends_a, ends_b, doc_a[own], doc_b[own])
    low_a, low_b, size_a, size_b = cut_a[:-1], cut_b[:-1], np.diff(cut_a), np.diff(cut_b)
    doc = np.searchsorted(doc_a, low_a, side="right") - 1

    sizes = size_a * size_b
    small = sizes <= WIDE * WIDE
    part = np.repeat(np.flatnonzero(small), sizes[small])
    within = _places(np.zeros(int(small.sum()), np.int64), sizes[small])
    wide = len(b.names)
    keys = [(doc[part] * len(a.names) + flat_a[low_a[part] + within // size_b[part]]) * wide + flat_b[low_b[part] + within % size_b[part]]]
    times = [np.ones(len(part), np.int64)]
    for g in np.flatnonzero(~small).tolist():  # of a large group each distinct pair once
        x, x_n = np.unique(flat_a[low_a[g] : cut_a[g + 1]], return_counts=True)
        y, y_n = np.unique(flat_b[low_b[g] : cut_b[g + 1]], return_counts=True)
        keys.append((((doc[g] * len(a.names) + x.astype(np.int64)) * wide)[:, None] + y).ravel())
        times.append((x_n[:, None] * y_n).ravel().astype(np.int64))
    if len(keys) == 1:
        pairs, n = np.unique(keys[0], return_counts=True)
    else:
        pairs, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, back, np.concatenate(times))
    of = pairs // (len(a.names) * wide)
    links = pa.StructArray.from_arrays([pa.array(pairs // wide % len(a.names), pa.int32()), pa.array(pairs % wide, pa.int32()), pa.array(n, pa.int64())], LINK.names)
    link_at = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)

    merged, ends = np.zeros(len(flat_a) + len(flat_b), np.int64), np.full(len(flat_a) + len(flat_b), ord(","), np.uint8)
    merged[np.arange(len(flat_a)) + np.repeat(low_b, size_a)] = flat_a
    merged[np.arange(len(flat_b)) + np.repeat(cut_a[1:], size_b)] = flat_b
    ends[cut_a[1:] + low_b - 1], ends[cut_a[1:] + cut_b[1:] - 1] = ord("|"), ord(";")
    ends[(doc_a + doc_b)[own][1:] - 1] = 0
    shown, at = _written(merged, ends, doc_a + doc_b, _digits(max(len(a.names), wide)))
    groups = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(shown)).cast(pa.string())
    n_groups, n_links = np.bincount(doc, minlength=len(texts)).astype(np.int64), np.zeros(len(texts), np.int64)
    np.add.at(n_links, doc, sizes)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_links), groups, pa.ListArray.from_arrays(pa.array(link_at), links)],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
    )


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every text's groups and links, a row for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, low, held = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, 0
            for i, text in enumerate(texts, 1):  # some texts at a time, since arrays over them are many times their size
                held += len(text or "")
                if held >= CHARACTERS or i == len(texts):
                    yield aligned_batch(ids[low:i], texts[low:i], both(path_a, path_b))
                    low, held = i, 0

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a: int, b: int, n: long>>"
    return own_columns(docs, "doc_id", "text").mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count (rows of links with the pair, so texts) and best (no pair of its a has a higher count). links: a, b."""
    counts = staged(links.groupBy("a", "b").agg(F.count("*").alias("count")), "pair_counts")
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(links: DataFrame, counts: DataFrame) -> DataFrame:
    """By row: links whose count is their a's highest, and the sum of counts over links. links: row, a, b, n."""
    counts = staged(counts, "scored_pairs")
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * HEAD_PAIRS > total  # fewer than HEAD_PAIRS pairs can be
    head, tail = F.broadcast(counts.where(often)), counts.where(~often)
    known = links.join(head, ["a", "b"])
    rest = links.join(head.select("a", "b"), ["a", "b"], "left_anti").join(tail, ["a", "b"])
    found = known.unionByName(rest)
    return found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [os.fspath(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    found = aligned(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    rows = staged(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"), "alignments")
    links = rows.select("row", F.inline("links"))
    sums = scored(links, pair_counts(links))
    kept = rows.drop("links").join(sums, "row", "left")
    return kept.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
