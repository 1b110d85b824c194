"""Token ids of whole texts in binary files of compressed bit or byte planes.

Documents are range-partitioned and sorted by key; each task encodes its documents and
writes one file. A file is a row of chunks of ``CHUNK`` ids. The 32-bit ids of a chunk
are transposed into planes (all first bits, all second bits … or bytes), each plane is
compressed with zstandard (byte planes by default, which came out an eighth smaller here
than bit planes), and an index at the end of the file says where every chunk
and plane lies and which ids belong to which document:

    "VGTP1" | plane … plane | index (JSON, zstandard) | index length, 8 bytes | "VGTP1"

A task writes under a name of its own attempt and hands back a manifest row only when
the file is complete; the stored manifest, not the folder, says which files count. So a
task that is lost or runs twice leaves at most a file that nobody reads.

Only plane buffers of one chunk, the texts of one Arrow batch and the bounded word tables
of :mod:`versegrid.llm.bpe` are in memory.

Defined cases: a null text is empty and gets the end id alone; a null key sorts first
and is kept; rows repeated with one key follow each other in order of text; an empty
table gives no file and no row. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from versegrid.llm import bpe
from versegrid.session import stage, staging_path

MAGIC = b"VGTP1"
END_ID = 2
CHUNK = 1 << 18
#: Characters of text that are encoded together.
GROUP = 1 << 20


def encoder(path: str):
    """A function from texts to their ids as little-endian 32-bit bytes."""
    return bpe.encoder(path).ids


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """Planes of little-endian 32-bit ids, from the highest bit or byte down."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, ::-1]
    if plane == "byte":
        return [np.ascontiguousarray(octets[:, i]).tobytes() for i in range(4)]
    planes = []
    for i in range(4):
        column = np.ascontiguousarray(octets[:, i])
        planes += [np.packbits((column >> b) & 1).tobytes() for b in range(7, -1, -1)]
    return planes


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    octets = np.zeros((4, n), np.uint8)
    for i in range(4):
        if plane == "byte":
            octets[i] = np.frombuffer(planes[i], np.uint8)
            continue
        for b in range(8):
            octets[i] |= np.unpackbits(np.frombuffer(planes[8 * i + b], np.uint8), count=n) << (7 - b)
    return np.ascontiguousarray(octets[::-1].T).reshape(-1).view("<u4")


class FileWriter:
    """Writes one file; ``add`` takes a document's packed ids, ``close`` the index."""

    def __init__(self, stream, plane: str, chunk: int, level: int):
        self.stream, self.plane, self.chunk = stream, plane, chunk
        self.zip = zstandard.ZstdCompressor(level=level)
        self.keys: list = []
        self.lengths: list[int] = []
        self.chunks: list[list[int]] = []
        self.rest = bytearray()
        self.at = self.stream.write(MAGIC)

    def add(self, key, ids: bytes) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.rest += ids
        while len(self.rest) >= 4 * self.chunk:
            self._put(self.rest[:4 * self.chunk])
            del self.rest[:4 * self.chunk]

    def _put(self, ids) -> None:
        packed = [self.zip.compress(p) for p in to_planes(np.frombuffer(bytes(ids), "<u4"), self.plane)]
        self.chunks.append([self.at, len(ids) // 4, *map(len, packed)])
        self.at += self.stream.write(b"".join(packed))

    def close(self) -> int:
        if self.rest:
            self._put(self.rest)
        index = self.zip.compress(json.dumps(
            {"plane": self.plane, "chunk": self.chunk, "keys": self.keys, "lengths": self.lengths,
             "chunks": self.chunks}).encode())
        self.stream.write(index + struct.pack("<Q", len(index)) + MAGIC)
        return sum(self.lengths)


def read_index(source) -> dict:
    size = source.size()
    tail = source.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
    if tail[8:] != MAGIC:
        raise ValueError("not a complete token file")
    length = struct.unpack("<Q", tail[:8])[0]
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read_at(length, size - 8 - len(MAGIC) - length)))


def read_chunk(source, index: dict, number: int) -> np.ndarray:
    at, n, *lengths = index["chunks"][number]
    data, unzip, planes = memoryview(source.read_at(sum(lengths), at)), zstandard.ZstdDecompressor(), []
    for length in lengths:
        planes.append(unzip.decompress(data[:length]))
        data = data[length:]
    return from_planes(planes, n, index["plane"])


def read_documents(source) -> Iterator[tuple[object, int, np.ndarray]]:
    """``(key, start within the file, ids)`` of each document, one chunk at a time."""
    index = read_index(source)
    parts, held, number, start = [], 0, 0, 0
    for key, length in zip(index["keys"], index["lengths"]):
        while held < length:
            parts.append(read_chunk(source, index, number))
            held, number = held + len(parts[-1]), number + 1
        ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
        yield key, start, ids[:length]
        parts, held, start = [ids[length:]], len(ids) - length, start + length


def _encoded(batch: pa.RecordBatch, encode) -> Iterator[tuple[object, int, bytes]]:
    """``(key, part, ids)`` of the rows of a batch; texts are encoded some ``GROUP`` characters at a time."""
    rows, size = [], 0
    for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        rows.append((row[0], row[1], row[2].as_py() or ""))
        size += len(rows[-1][2])
        if size >= GROUP:
            yield from ((k, p, ids) for (k, p, _), ids in zip(rows, encode([r[2] for r in rows])))
            rows, size = [], 0
    yield from ((k, p, ids) for (k, p, _), ids in zip(rows, encode([r[2] for r in rows])))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text",
                 plane: str = "byte", chunk: int = CHUNK, level: int = 1, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` in key order into files below ``folder``; the stored manifest ``(part, path, n_docs, n_tokens)``.

    ``tokenizer`` is a file that every executor can open.
    """
    end = struct.pack("<I", end_id)

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, path, part = encoder(tokenizer), None, "", 0
        for batch in stream:
            for k, p, ids in _encoded(batch, encode):
                if writer is None:
                    part = p
                    path = f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                    store, inner = fs.FileSystem.from_uri(path)
                    store.create_dir(os.path.dirname(inner), recursive=True)
                    out = store.open_output_stream(inner)
                    writer = FileWriter(out, plane, chunk, level)
                writer.add(k, ids + end)
        if writer:
            n = writer.close()
            out.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(writer.keys)], pa.int64()),
                                   pa.array([n], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    ordered = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange("key").withColumn(
        "part", F.spark_partition_id()).select("key", "part", "text").sortWithinPartitions("key", "text")
    return stage(ordered.mapInArrow(write, "part int, path string, n_docs long, n_tokens long"), "token-manifest")


def token_index(manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read back from the files, ``start`` over all files.

    One task reads one file chunk by chunk. The window numbers one row per file.
    """
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as source:
                    rows = [(k, base + s, len(ids), zlib.crc32(ids.tobytes())) for k, s, ids in read_documents(source)]
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(columns[0], pa.int64() if key_type == "bigint" else None),
                                       *[pa.array(c, pa.int64()) for c in columns[1:]]],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return files.repartition(n, F.xxhash64("path")).mapInArrow(
        read, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long")


def default_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared staging folder."""
    path = staging_path(spark, "tokens")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
