"""Packing token ids into sequences by power-of-two decomposition.

A document of T ids (its end id included) is cut into as many pieces of ``MOST`` ids as
fit, and the rest into pieces of the binary digits of its length, longest first. Every
piece is a sequence of its own: no sequence holds ids of two documents, and as all
lengths are powers of two none is padded. Pieces of one length form a bucket, stored as
one folder, so a trainer draws whole batches of one length from it.

Each task encodes its own documents and stores its pieces; nothing is shuffled. Places
within a bucket are counted per task, and ``sequence_id`` is put together from bucket,
task and place (see :func:`sequence_ids`), so it is unique without a global count. The
stored table is what counts: a lost task is run again on the same rows and only its
committed files are read.

Only the texts of one Arrow batch, the ids of about ``bpe.GROUP`` characters and a bounded
table of known words are in memory.

Defined cases: a null text is empty, and an empty one is its end id alone, a piece of
length 1. Null keys stay; rows repeated with one key are packed each for itself. An
empty table gives no piece. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versegrid.llm import bpe
from versegrid.session import staging_path

MOST = 1024
END_ID = 0
#: Bits of a sequence id for the place within a task and for the task.
PLACE_BITS, TASK_BITS = 32, 27


def binary_lengths(n: int, most: int = MOST) -> list[int]:
    """The piece lengths of a document of ``n`` ids."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of runs of rows with some ``bpe.GROUP`` characters."""
    first, texts, size = 0, [], 0
    for i, value in enumerate(batch.column(1)):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= bpe.GROUP:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", most: int = MOST,
         end_id: int = END_ID) -> DataFrame:
    """The stored sequences ``(key, start, doc_tokens, task, place, ids, length)``, one folder per length.

    ``ids`` are little-endian unsigned 32-bit integers. ``tokenizer`` is a file that every
    executor can open; ``most`` is a power of two.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = struct.pack("<I", end_id)
    tails = [binary_lengths(n, most) for n in range(most)]

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = bpe.encoder(tokenizer), TaskContext.get().partitionId()
        placed = np.zeros(most.bit_length(), np.int64)
        for batch in stream:
            for first, texts in _groups(batch):
                ids = [x + end for x in encode.ids(texts)]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                pieces = [[most] * (n // most) + tails[n % most] for n in sizes.tolist()]
                owner = np.repeat(np.arange(len(ids)), [len(p) for p in pieces])
                lengths = np.array([n for p in pieces for n in p], np.int64)
                ends = np.cumsum(lengths)
                level = np.log2(lengths).astype(np.int64)
                place = np.empty(len(lengths), np.int64)
                for k in range(len(placed)):
                    mine = level == k
                    place[mine] = placed[k] + np.arange(mine.sum())
                    placed[k] += mine.sum()
                bounds = np.concatenate([[0], 4 * ends]).astype(np.int32)
                yield pa.record_batch([
                    batch.column(0).take(pa.array(first + owner)),
                    pa.array(ends - lengths - (np.cumsum(sizes) - sizes)[owner]), pa.array(sizes[owner]),
                    pa.array(np.full(len(lengths), task, np.int32)), pa.array(place),
                    pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(ids))]),
                    pa.array(lengths.astype(np.int32))],
                    names=["key", "start", "doc_tokens", "task", "place", "ids", "length"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    pieces = docs.select(key, text).mapInArrow(
        cut, f"key {kind}, start long, doc_tokens long, task int, place long, ids binary, length int")
    path = staging_path(docs.sparkSession, "packed")
    pieces.write.partitionBy("length").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(pieces.schema).parquet(path)


def sequence_ids(length: Column, task: Column, place: Column) -> Column:
    """Bucket (exponent of the length), task and place in one number; increasing in that order."""
    exponent = F.bit_count(length - 1).cast("long")
    return F.shiftleft(exponent, PLACE_BITS + TASK_BITS) + F.shiftleft(task.cast("long"), PLACE_BITS) + place


def packed_pieces(sequences: DataFrame) -> DataFrame:
    """``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of each stored piece; offsets are 0."""
    return sequences.select(
        "key", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        sequence_ids(F.col("length"), F.col("task"), F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def bucket(sequences: DataFrame, length: int) -> DataFrame:
    """The sequences of one length; only the files of that bucket are read."""
    return sequences.filter(F.col("length") == length)
