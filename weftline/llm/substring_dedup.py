"""Substring dedup: Rabin-Karp hashes of every window of ``WINDOW`` tokens, counted in Spark.

A window is repeated if its word sequence also starts earlier (smaller doc_id, or earlier in the same document); repeated
windows merge into maximal intervals of words to remove.

To count every window without a shuffled row for each, windows travel in runs. Each window is named by the smallest hash
among its ``GRAM``-word grams; a run is a stretch of windows named by one and the same gram, 1 to 15 of them. Equal windows
have equal names, so all that is to be known of a window lies with the runs of its name. Runs are sorted by name, then by
a hash of all their words, then by place, in ranges that may cut through any name, however common:
- a run whose words stand in the order before it is repeated as a whole;
- a run with a name of its own has no repeated window;
- the first runs of different words under one name (and whatever stands at the edge of a sorted batch, which costs work
  but changes nothing) are opened: their windows are hashed, the earliest of each is found and the others are repeated.
Names, runs and windows are told apart by two 64-bit hashes together.

Defined results: a null text has no words; fewer than WINDOW words, no window; a null doc_id comes before all others; rows
that repeat a doc_id are ordered by a hash of their texts, and rows equal in both are one document reported each time;
an empty table gives no rows; other columns are ignored (``digest``) or kept (``remove_repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, own_columns, release, staged, table
from weftline.llm.textarrays import Texts, gram_hashes, range_hashes

WINDOW, GRAM = 20, 6
RUN = "name long, words long, doc_id long, text_hash long, start int, size int"


def _keyed(docs: DataFrame) -> DataFrame:
    return own_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _batch(columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Every run of every text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Texts(b.column(2))
            at = np.flatnonzero(t.same_text(window))
            if not len(at):
                continue
            words = t.word_hashes()
            grams = gram_hashes(words, gram)
            named_by = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(1)[at] + at
            new = np.concatenate(([True], (named_by[1:] != named_by[:-1]) | (np.diff(at) != 1)))
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate((first, [len(at)])))
            start = at[first]
            text = t.text[start]
            row = pa.array(text)
            yield _batch({
                "name": _signed(grams[named_by[first]]), "words": _signed(range_hashes(words, start, start + size + window - 1)),
                "doc_id": b.column(0).take(row), "text_hash": b.column(1).take(row), "start": (start - t.word_at[text]).astype(np.int32), "size": size.astype(np.int32),
            })

    return _keyed(docs).mapInArrow(run, RUN)


def judged_runs(found: DataFrame) -> DataFrame:
    """Runs that are repeated (opened false) or have to be opened (true); the others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            name, words = b.column(0).to_numpy(), b.column(1).to_numpy()
            new_name = np.concatenate(([True], name[1:] != name[:-1]))
            first = new_name | np.concatenate(([True], words[1:] != words[:-1]))
            group = np.cumsum(new_name) - 1
            contents = np.bincount(group, first)
            unsure = contents[group] > 1
            unsure |= (group == 0) | (group == group[-1])
            again = np.zeros(len(name), bool)  # the same place once more: a repeated row of the table
            again[1:] = ~first[1:]
            for k in ("doc_id", "text_hash", "start"):
                value = b.column(k).fill_null(np.iinfo(np.int64).min) if k == "doc_id" else b.column(k)
                again[1:] &= np.diff(value.to_numpy()) == 0
            keep = pa.array((~first | unsure) & ~again)
            yield pa.RecordBatch.from_arrays([*[b.column(k).filter(keep) for k in ("name", "doc_id", "text_hash", "start", "size")], pa.array(first).filter(keep)], ["name", "doc_id", "text_hash", "start", "size", "opened"])

    order = ["name", "words", "doc_id", "text_hash", "start"]
    bounded_batches(found.sparkSession)
    return found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "name long, doc_id long, text_hash long, start int, size int, opened boolean")


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _packed(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, high and low half of every packed value of a list column."""
    rows = np.repeat(np.arange(len(column)), np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    values = column.flatten().to_numpy()
    return rows, values >> 32, values & 0xFFFFFFFF


def opened_windows(docs: DataFrame, judged: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each window of the runs to open."""
    bounded_batches(docs.sparkSession)
    asked = judged.where("opened").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(_packed(F.col("start"), F.col("size")).alias("at"), "name")).alias("runs"))
    asked = asked.select("doc_id", "text_hash", F.transform("runs", lambda r: r["at"]).alias("at"), F.transform("runs", lambda r: r["name"]).alias("names"))
    keyed = _keyed(docs)
    joined = keyed.join(asked, _same_document(keyed, asked)).select(keyed["doc_id"], keyed["text_hash"], "text", "at", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Texts(b.column(2))
            hashes = gram_hashes(t.word_hashes(), window)
            row, start, size = _lists(b.column(3))
            each = np.repeat(np.arange(len(row)), size)
            place = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
            of = pa.array(row[each])
            yield _batch({"name": b.column(4).flatten().take(pa.array(each)), "hash": _signed(hashes[t.word_at[row[each]] + place]), "doc_id": b.column(0).take(of), "text_hash": b.column(1).take(of), "start": place.astype(np.int32)})

    return joined.mapInArrow(run, "name long, hash long, doc_id long, text_hash long, start int")


def removal_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash and the spans to remove (start << 32 | words, they may overlap) of every text that has some."""
    spark = docs.sparkSession
    judged = staged(judged_runs(runs(docs, window, gram)), "runs")
    release(spark)
    windows = staged(opened_windows(docs, judged, window), "windows")
    release(spark)
    place = F.struct("doc_id", "text_hash", "start")
    earliest = windows.groupBy("name", "hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(earliest, ["name", "hash"]).where(~F.col("first").eqNullSafe(place)).select("doc_id", "text_hash", _packed(F.col("start"), F.lit(window)).alias("span"))
    whole = judged.where("not opened").select("doc_id", "text_hash", _packed(F.col("start"), F.col("size") + (window - 1)).alias("span"))
    return whole.unionByName(later).groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"))


def kept_words(t: Texts, spans: pa.Array) -> np.ndarray:
    """For each word of a batch, whether no span covers it."""
    row, start, words = _lists(spans)
    edge = np.zeros(len(t.text) + 1, np.int64)
    np.add.at(edge, t.word_at[row] + start, 1)
    np.add.at(edge, t.word_at[row] + start + words, -1)
    return np.cumsum(edge[:-1]) == 0


def kept_texts(t: Texts, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    inside = np.zeros(len(t.data) + 1, np.int8)
    inside[t.starts[keep]] += 1
    inside[t.ends[keep] + 1] -= 1  # with the separator after the word
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    data = t.data.copy()
    data[t.ends] = 0x20
    out = data[inside].tobytes()
    upto = np.concatenate(([0], np.cumsum(t.per_text(inside)))).tolist()
    return [out[a : max(a, b - 1)] for a, b in zip(upto, upto[1:], strict=False)]


def _with_spans(docs: DataFrame, window: int, gram: int, more: tuple[str, ...] = ()) -> DataFrame:
    spans = removal_intervals(docs, window, gram)
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__of"), F.col("spans").alias("__spans"))
    own = docs.select(*[F.col(f"`{c}`") for c in ("doc_id", "text", *more)]).withColumn("__hash", F.xxhash64("text"))
    joined = own.join(spans, own["doc_id"].eqNullSafe(spans["__id"]) & (own["__hash"] == spans["__of"]), "left")
    return joined.select("doc_id", "text", *[F.col(f"`{c}`") for c in more], "__spans")


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Texts(b.column(1))
            keep = kept_words(t, b.column(2))
            shas = [hashlib.sha256(x).hexdigest() for x in kept_texts(t, keep)]
            yield _batch({"doc_id": b.column(0), "n_words": t.n_words, "n_removed": t.per_text_words(~keep), "kept_sha256": pa.array(shas, pa.string())})

    joined = _with_spans(docs, window, gram)
    bounded_batches(docs.sparkSession)
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the kept words, joined by one space, as text; a null text stays null."""
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    joined = _with_spans(docs, window, gram, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Texts(b.column(1))
            texts = pa.array([x.decode() for x in kept_texts(t, kept_words(t, b.column(b.num_columns - 1)))], pa.string())
            texts = pc.if_else(b.column(1).is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), texts, *[b.column(2 + i) for i in range(len(more))]], ["doc_id", "text", *more])

    out = "doc_id long, text string" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    bounded_batches(docs.sparkSession)
    return joined.mapInArrow(run, out).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
