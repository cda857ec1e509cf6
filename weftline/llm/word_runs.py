"""Runs of words that repeat with a period (boilerplate loops, stuttering generations), found and collapsed.

A text's words are appended one by one to a suffix automaton. Its suffix links form a tree in which every node knows, by the
preferred path it lies on, where its strings ended last. Accessing the path of an appended word in a link-cut tree walks the
segments of that path that ended at one place: a segment whose longest string is at least as long as the distance between
its previous and its new end is a square, and the longest string tells where the repetition begins. Repetitions that begin
at one place with one period are one run, whose end is the last word that reports it.

Before that, words that can't lie in a run are cut out: a run holds each of its words four times at least, so a stretch of
text is cut at words that it holds less often, until nothing changes. Counting is by hashes, where a collision only cuts
less; the automaton compares words.

Defined results: a null or empty text has no words and no runs, its collapsed text is empty; a text of any length is
looked at whole, with memory for the automaton in proportion to its longest uncut stretch; rows are independent of each other, so repeated rows
give repeated results and null ids are ids like others (though never planted); other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, own_columns, table
from weftline.llm.textarrays import U64, Texts, mixed

REPEATS, LEAST = 4, 6
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Occurrences:
    """A suffix automaton of the words appended so far, its suffix-link tree as a link-cut tree. An auxiliary tree is a path
    whose strings all ended last at the place that its root's ``last`` tells."""

    def __init__(self) -> None:
        self.next, self.link, self.length = [{}], [-1], [0]
        self.left, self.right, self.up, self.last = [-1], [-1], [-1], [-1]
        self.whole, self.n = 0, 0

    def _node(self, length: int, steps: dict, link: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        for column in (self.left, self.right, self.up, self.last):
            column.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        if y < 0 or (left[y] != x and right[y] != x):
            return
        while True:
            z = up[y]
            inner = z >= 0 and (left[z] == y or right[z] == y)
            if inner and (left[z] == y) == (left[y] == x):
                self._rotate(y)
            elif inner:
                self._rotate(x)
            self._rotate(x)
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                break

    def _rotate(self, x: int) -> None:
        """x above its parent in the auxiliary tree; the root's place goes with the root."""
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b >= 0:
            up[b] = y
        up[x], up[y] = z, x
        if z >= 0 and left[z] == y:
            left[z] = x
        elif z >= 0 and right[z] == y:
            right[z] = x
        else:
            self.last[x] = self.last[y]

    def _between(self, q: int, length: int) -> int:
        """A copy of q for its shorter strings, on q's path, right above q."""
        copy = self._node(length, dict(self.next[q]), self.link[q])
        self._splay(q)
        above = self.left[copy] = self.left[q]
        if above >= 0:
            self.up[above] = copy
        self.left[q], self.up[copy] = copy, q
        self.link[q] = copy
        return copy

    def append(self, word: int) -> list[tuple[int, int]]:
        """The squares that end at this word and repeat REPEATS times: (period, longest repeated suffix)."""
        steps, link, length = self.next, self.link, self.length
        i, p = self.n, self.whole
        now = self.whole = self._node(length[p] + 1, {}, 0)
        self.n += 1
        while p >= 0 and word not in steps[p]:
            steps[p][word] = now
            p = link[p]
        if p >= 0:
            q = steps[p][word]
            if length[q] != length[p] + 1:
                copy = self._between(q, length[p] + 1)
                while p >= 0 and steps[p].get(word) == q:
                    steps[p][word] = copy
                    p = link[p]
                q = copy
            link[now] = q
        self.up[now] = link[now]
        return self._access(now, i)

    def _access(self, x: int, i: int) -> list[tuple[int, int]]:
        right, up, last, length = self.right, self.up, self.last, self.length
        below, found = -1, []
        while x >= 0:
            self._splay(x)
            at = last[x]
            if at >= 0 and (REPEATS - 1) * (i - at) <= length[x]:
                found.append((i - at, length[x]))
            if right[x] >= 0:
                last[right[x]] = at
            right[x] = below
            below, x = x, up[x]
        last[below] = i
        return found


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch that repeats its smallest period REPEATS times and has LEAST words."""
    ids: dict = {}
    automaton, ends = Occurrences(), {}
    for i, word in enumerate(words):
        for period, repeated in automaton.append(ids.setdefault(word, len(ids))):
            ends[i - repeated - period + 1, period] = i
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items() if end - start + 1 >= LEAST)


def _stretches(names: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Spans of words that may hold runs: within a span every word occurs REPEATS times. names: hashes of the words; text: which text each is of."""
    at, part = np.arange(len(names)), text.astype(U64)
    while len(at):
        _, back, n = np.unique(mixed(part * U64(0x9E3779B97F4A7C15) ^ names[at]), return_inverse=True, return_counts=True)
        often = n[back] >= REPEATS
        kept, kept_part = at[often], part[often]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(kept) > 1) | (kept_part[1:] != kept_part[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(kept)))
        long = np.repeat(sizes >= LEAST, sizes)
        done = often.all() and long.all()
        at, part = kept[long], np.repeat(np.arange(len(sizes)), sizes)[long].astype(U64)
        if done:
            return list(zip(at[starts].tolist(), (at[starts] + sizes).tolist(), strict=True))
    return []


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a text's words are made periodic, and with what period, as a tenth of all texts are for measuring this operator."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _batch(ids: list, column: pa.Array, plant: bool) -> pa.RecordBatch:
    t = Texts(column)
    source = np.arange(len(t.starts))  # which word stands at each place
    for i, (doc_id, n) in enumerate(zip(ids, t.n_words.tolist(), strict=True)):
        found = planted(doc_id, n) if plant else None
        if found:
            first, (a, p) = int(t.word_at[i]), found
            source[first + a : first + n] = first + a + np.arange(n - a) % p
    names = t.word_hashes()[source]
    runs: list[list] = [[] for _ in ids]
    dropped = np.zeros(len(source), bool)
    whole = memoryview(t.data)
    for low, high in _stretches(names, t.text):
        i = int(t.text[low])
        places = source[low:high]
        words = [bytes(whole[s:e]) for s, e in zip(t.starts[places].tolist(), t.ends[places].tolist(), strict=True)]
        for start, length, period in runs_of(words):
            runs[i].append((low - int(t.word_at[i]) + start, length, period))
            dropped[low + start + period : low + start + length] = True
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([[dict(zip(RUN.names, r, strict=True)) for r in sorted(found, key=lambda r: (r[0], r[2]))] for found in runs], pa.list_(RUN)), _joined(t, source, ~dropped)],
        ["doc_id", "runs", "text"],
    )


def _joined(t: Texts, source: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    text, places = t.text[kept], source[kept]
    final = np.append(text[1:] != text[:-1], True)[: len(text)]
    sizes = t.ends[places] - t.starts[places] + ~final
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    data = t.data[np.arange(total) + np.repeat(t.starts[places] - (upto - sizes), sizes)]
    data[upto[~final] - 1] = 0x20
    offsets = np.concatenate(([0], np.cumsum(np.bincount(text, sizes, minlength=t.n).astype(np.int64))))
    return pa.LargeStringArray.from_buffers(t.n, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def collapsed(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, runs (start, length, period, by start and period) and the text without the words of each run after its first period.
    plant: first make a tenth of the texts periodic."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _batch(b.column(0).to_pylist(), b.column(1), plant)

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document with planted repetitions: its runs, the one that repeats most often, digests of runs and collapsed text."""
    found = collapsed(table(spark, sf_dir, "documents"), plant=True)
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")
    most = F.reduce("runs", nothing, lambda best, x: F.when(best.isNull() | more(x, best), x).otherwise(best))  # runs are in order: the first of equals stays
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return found.withColumn("most", most).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period",
        F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
