"""Token-id output as length-delimited binary records with a separate offset index.

A shard holds records in ascending doc_id order. Each record is framed as

    length   8 bytes, little-endian
    masked CRC-32 of the length bytes   4 bytes
    payload  a flag byte (1: the doc_id is null), doc_id (8 bytes), ids (16 or 32 bits each, little-endian)
    masked CRC-32 of the payload        4 bytes

The mask is a rotation by 15 bits plus a constant, so that a checksum stored inside checksummed data does no harm. The
offset index is a Parquet table with a row for each record (shard file, offset, length, tokens, tokens before it in the
shard); with it records are read in any order. Texts are dealt by ranges of doc_id, every task writes its own shard and
names it after its attempt, and only files named in the committed index count: a task that is run again after a lost
executor leaves at most an orphan file.

Defined results: a null or empty text is a record with the end id alone; null doc_ids come first; rows that repeat a
doc_id stand side by side, ordered by a hash of their texts and then by the texts; an empty table gives an empty index;
other columns are ignored.
"""

from __future__ import annotations

import os
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, own_columns, scratch, table
from weftline.llm.tokenizing import encoder

MASK, HEAD, TAIL, OWN = 0xA282EAD8, "<QI", "<I", "<?q"
HEAD_BYTES, TAIL_BYTES, OWN_BYTES = map(struct.calcsize, (HEAD, TAIL, OWN))
INDEX = "shard int, file string, ordinal long, doc_id long, offset long, length long, n_tokens long, shard_start long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((struct.pack(HEAD, len(payload), masked_crc(size)), payload, struct.pack(TAIL, masked_crc(payload))))


def unframed(record: bytes) -> bytes:
    """The payload; ValueError if a length or checksum is wrong."""
    size, size_crc = struct.unpack_from(HEAD, record)
    payload = record[HEAD_BYTES : HEAD_BYTES + size]
    if size_crc != masked_crc(record[:8]) or len(record) != HEAD_BYTES + size + TAIL_BYTES or struct.unpack_from(TAIL, record, HEAD_BYTES + size)[0] != masked_crc(payload):
        raise ValueError("a record's length or checksum is wrong")
    return payload


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the shards and the index below ``folder``; the index, read back."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get(), encoder(tokenizer)
        name, ordinal, offset, before = f"{folder}/shards/shard-{task.partitionId():06d}-{task.taskAttemptId()}.bin", 0, 0, 0
        sink = None
        for b in batches:
            if not b.num_rows:
                continue
            if sink is None:
                files, path = fs.FileSystem.from_uri(name)
                files.create_dir(posixpath.dirname(path), recursive=True)
                sink = files.open_output_stream(path)
            ids, at = encode.ids(b.column(1))
            end = np.array([end_id], encode.dtype).tobytes()
            rows = []
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                record = framed(b"".join((struct.pack(OWN, doc_id is None, doc_id or 0), ids[at[i] : at[i + 1]].tobytes(), end)))
                sink.write(record)
                n = int(at[i + 1] - at[i]) + 1
                rows.append((task.partitionId(), name, ordinal, doc_id, offset, len(record), n, before))
                ordinal, offset, before = ordinal + 1, offset + len(record), before + n
            kinds = (pa.int32(), pa.string(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if sink is not None:
            sink.close()

    ranged = own_columns(docs, "doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
    ranged.sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``, the tokens of all records before one: sums of whole shards, then the place in its own."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return index.join(shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shard").withColumn("start", F.col("base") + F.col("shard_start"))


def read_records(index: DataFrame, bits: int) -> DataFrame:
    """doc_id, start, n_tokens and ids of every record that ``index`` (with ``start``) names, in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, start, ids in _records(batches, bits):
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], ["doc_id", "start", "n_tokens", "ids"])

    return _dealt(index).mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def read_digests(index: DataFrame, bits: int) -> DataFrame:
    """As read_records, with the checksum of the ids as unsigned 32-bit integers in place of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, start, ids in _records(batches, bits):
            crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, [len(x) for x in ids], crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _dealt(index).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _dealt(index: DataFrame) -> DataFrame:
    """Stretches of each file go to different tasks, so a large shard is no single task's work. The number of tasks is
    given because the index is far smaller than what it names."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("file", "offset", "length", "start", F.expr("ordinal div 1024").alias("stretch")).repartition(tasks, "file", "stretch").drop("stretch")


def _records(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    open_name, source = None, None
    for b in batches:
        rows = sorted(zip(*[b.column(i).to_pylist() for i in range(4)], strict=True))
        for low in range(0, len(rows), 1024):
            docs, starts, ids = [], [], []
            for name, offset, length, start in rows[low : low + 1024]:
                if name != open_name:
                    files, path = fs.FileSystem.from_uri(name)
                    open_name, source = name, files.open_input_file(path)
                payload = unframed(source.read_at(length, offset))
                null, doc_id = struct.unpack_from(OWN, payload)
                docs.append(None if null else doc_id)
                starts.append(start)
                ids.append(np.frombuffer(payload, f"<u{bits // 8}", offset=OWN_BYTES))
            yield docs, starts, ids


def op5_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    index = write_records(table(spark, sf_dir, "documents"), scratch(spark, "records"), path, end_id=0)
    return read_digests(with_starts(index), bits=8 * encoder(os.fspath(path)).dtype.itemsize)
