"""Best-fit packing of documents into fixed-length sequences, after Martello-Toth dominance reduction.

Only the number of pieces of each length matters for packing, and there are at most ``capacity`` lengths whatever the
corpus: Spark counts them, the driver plans on the counts, and Spark deals the pieces to the planned places.

``reduce_dominated`` fixes small sets that some optimal packing contains, and shrinks the instance:
a piece with which no other fits; a pair that fills a sequence exactly (whatever else could share the first piece's
sequence fits in the second one's place); and a pair of a piece with the largest that fits it where no two others would.
``best_fit`` packs the rest by falling length, always into the fullest sequence with room, many equal sequences at once.
A plan is a list of shapes (how many sequences, runs of equal lengths in each); its size depends on capacity alone.

Defined results: a null or empty text is a piece with the end id; a null doc_id is a document like others; rows that
repeat a doc_id are packed one by one; an empty table gives no pieces; other columns are ignored. Among pieces of one
length the order of the input's partitions decides, which changes no count.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, own_columns, staged, table
from weftline.llm.tokenizing import encoder

CAPACITY = 4096
Shape = tuple[int, tuple[tuple[int, int], ...]]  # sequences, runs of (length, pieces)
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, more: tuple[str, ...] = ()) -> DataFrame:
    """A row for each piece, with the task that cut it and its rank among that task's pieces of the same length."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            ids, at = encode.ids(b.column(1))
            end = np.array([end_id], "<u4").tobytes()
            n = np.diff(at) + 1
            cuts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            crcs = np.empty(len(row), np.int64)
            for i, (r, s, l) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                crc = zlib.crc32(ids[at[r] + s : min(at[r] + s + l, at[r + 1])].astype("<u4").tobytes())
                crcs[i] = zlib.crc32(end, crc) if s + l == n[r] else crc
            order = np.argsort(length, kind="stable")
            among = np.arange(len(order)) - np.searchsorted(length[order], length[order])
            rank = np.empty(len(order), np.int64)
            rank[order] = among
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            cols = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crcs, rank)], pa.array(np.full(len(row), part), pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, *[b.column(k).take(pa.array(row)) for k in more]], ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part", *more])

    own = own_columns(docs, "doc_id", "text", *more)
    extra = "".join(f", `{k}` {own.schema[k].dataType.simpleString()}" for k in more)
    return own.mapInArrow(run, f"{PIECE}, rank long, part int{extra}")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Shape], dict[int, int]]:
    """Shapes that are fixed for good, and what is left to pack."""
    left, fixed = {k: n for k, n in counts.items() if n}, []

    def take(n: int, *lengths: int) -> None:
        fixed.append((n, tuple((k, lengths.count(k)) for k in sorted(set(lengths), reverse=True))))
        for k in lengths:
            left[k] -= n
            if not left[k]:
                del left[k]

    for k in sorted(left, reverse=True):
        other = capacity - k
        if k in left and other == 0:
            take(left[k], k)
        elif k in left and other in left and k >= other:
            n = left[k] // 2 if k == other else min(left[k], left[other])
            if n:
                take(n, k, other)
    ordered = sorted(left)
    while ordered:
        k = ordered[-1]
        n = left.get(k, 0)
        if not n:
            ordered.pop()
            continue
        small = [x for x in ordered[:3] for _ in range(min(2, left[x] - (x == k)))][:2]
        if not small or k + small[0] > capacity:
            take(n, k)
        elif len(small) < 2 or k + sum(small) > capacity:
            i = bisect_left(ordered, capacity - k + 1) - 1
            while i >= 0 and ordered[i] == k and left[k] < 2:
                i -= 1
            other = ordered[i]
            take(left[k] // 2 if other == k else min(left[k], left[other]), k, other)
        else:
            break
        ordered = [x for x in ordered if x in left]
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Shape]:
    """Best fit by falling length, on groups of sequences with equal room."""
    rooms: dict[int, list[tuple[int, tuple]]] = {}
    order: list[int] = []  # rooms that some sequence has, rising

    def put(room: int, n: int, runs: tuple) -> None:
        if n and room not in rooms:
            rooms[room] = []
            insort(order, room)
        if n:
            rooms[room].append((n, runs))

    for k in sorted(counts, reverse=True):
        n = counts[k]
        while n:
            i = bisect_left(order, k)
            if i == len(order):
                room, each = capacity, min(n, capacity // k)
                groups = [(-(-n // each), ())]
            else:
                room = order.pop(i)
                groups, each = rooms.pop(room), room // k
            for size, runs in groups:
                full = min(size, n // each)
                put(room - each * k, full, (*runs, (k, each)))
                n -= full * each
                rest = size - full
                if rest and n:
                    put(room - n * k, 1, (*runs, (k, n)))
                    n, rest = 0, rest - 1
                if room < capacity or runs:
                    put(room, rest, runs)
    return [g for groups in rooms.values() for g in groups]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Shape]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(plan: list[Shape]) -> pd.DataFrame:
    """For each run of a plan: the ranks among pieces of its length that it takes, and where they go."""
    rows, sequence, taken = [], 0, {}
    for n, runs in plan:
        offset = 0
        for k, each in runs:
            rows.append((k, taken.get(k, 0), each, sequence, offset))
            taken[k] = taken.get(k, 0) + n * each
            offset += k * each
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank", "each", "sequence", "offset"], dtype=np.int64).sort_values(["length", "rank"])


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, more: tuple[str, ...] = ()) -> DataFrame:
    """Every piece with its sequence_id and offset (and columns ``more`` of its document)."""
    cut = staged(pieces(docs, tokenizer, end_id, capacity, more), "pieces")
    by_task = cut.groupBy("part", "length").count()
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    plan = places(plan_packing(counts, capacity))
    # a length and a rank make one number in rising order
    keys, table_ = (plan["length"].to_numpy() << 45) + plan["rank"].to_numpy(), {k: plan[k].to_numpy() for k in plan}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in ("length", "rank"))
            rank = rank + b.column("before").to_numpy()
            i = np.searchsorted(keys, (length << 45) + rank, side="right") - 1
            nth, slot = np.divmod(rank - table_["rank"][i], table_["each"][i])
            kept = [b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32", *more)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(table_["sequence"][i] + nth), pa.array(table_["offset"][i] + slot * length)], ["doc_id", "piece", "start", "length", "ids_crc32", *more, "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    extra = "".join(f", `{k}` {cut.schema[k].dataType.simpleString()}" for k in more)
    return cut.join(before, ["part", "length"]).mapInArrow(run, f"{PIECE}{extra}, sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The token sequences themselves: sequence_id and ids. doc_id must name one document; a group is one sequence."""
    bounded_batches(docs.sparkSession)
    where = packed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            ids, at = encode.ids(b.column(0))
            out = []
            for i, spots in enumerate(b.column(1).to_pylist()):
                own = [*ids[at[i] : at[i + 1]].tolist(), end_id]
                out += [(p["sequence_id"], p["offset"], own[p["start"] : p["start"] + p["length"]]) for p in spots]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    parts = own_columns(docs, "doc_id", "text").join(where, "doc_id").select("text", "places").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
