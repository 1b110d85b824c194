"""Product codes of vectors with exact integer arithmetic on float64 matrix products.

A vector becomes integers, floor(scale * x), and is cut into equal parts. Each part position
has a codebook that starts as that part of the vectors with the smallest keys. Every
round assigns each part to the nearest entry and replaces an entry by the floor of its
parts' mean; entries that nothing chose stay. Then parts are assigned once more.

The scores |e|^2 - 2 x.e must be exact for ties to go to the lower index. Integers are broken into limbs so
narrow that a product of two limb matrices stays below 2^53, where a float64 BLAS product
is exact; the products are recombined in int64 and the first smallest score wins. Small
integers fit one limb, which then is a single BLAS call.

Spark stores the integers once; each round is a scan with per-task sums, added up by
entry. What the driver holds is the codebooks alone: ``entries`` vectors, whatever the
size of the input, plus one sum per entry. Assignments are never collected. Lost tasks are run again
from the stored integers.

Defined cases: rows whose vector is null or has null or non-finite components are
dropped. Vectors whose length is not the most frequent one (the shorter of equally
frequent ones), or no multiple of the number of parts, have no code and no error, both
null, and no part in the codebooks. Of rows with one key the smallest vector stands for
the key in the first codebooks; all rows are coded. Null keys are coded but start no entry. With fewer keys
than entries the codebooks are shorter, without any key no row has a code. Null labels are one label. An empty table gives
no rows. Integers so large that a distance would not fit 64 bits raise an error.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versegrid.session import stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one matrix product.
BLOCK = 4096


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as float64 matrices l0 + l1 * 2^bits + …, each limb within +-2^bits."""
    found = []
    while True:
        if not len(values) or max(abs(int(values.min())), abs(int(values.max()))) <= 1 << bits:
            return [*found, values.astype(np.float64)]
        found.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The int64 dot products of the rows of ``x`` and ``y``, exact wherever they fit 64 bits."""
    width = x.shape[1]
    largest = max((abs(int(m)) for v in (x, y) if v.size for m in (v.min(), v.max())), default=0)
    if width * largest * largest < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    bits = (53 - max(width, 1).bit_length()) // 2
    total = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            if bits * (i + j) < 64:  # higher limbs leave the 64 bits
                total += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lower of equals, and the squared distance to it."""
    if x.size and entries.size:
        span = max(int(x.max()), int(entries.max())) - min(int(x.min()), int(entries.min()))
        reach = max(abs(int(v)) for v in (x.min(), x.max(), entries.min(), entries.max()))
        if x.shape[1] * max(span * span, 3 * reach * reach) >= 1 << 63:
            raise ValueError("vector components are too large for 64-bit distances")
    score = (entries * entries).sum(1) - 2 * exact_products(x, entries)
    best = score.argmin(1)
    return best, score[np.arange(len(x)), best] + (x * x).sum(1)


def _integers(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _finite(embedding: Column) -> Column:
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (
        F.abs(x.cast("double")) < F.lit(float("inf"))))


def quantized(vectors: DataFrame, key: str, vector: str, label: str, scale: int, parts: int) -> DataFrame:
    """The stored ``(key, label, ints, usable)`` of the rows that are kept."""
    kept = vectors.filter(_finite(F.col(vector))).select(
        F.col(key).alias("key"), F.col(label).alias("label"), _integers(F.col(vector), scale).alias("ints"))
    kept = stage(kept, "vector-integers")
    row = kept.groupBy(F.size("ints").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    width = row["width"] if row and row["width"] % parts == 0 else -1
    return kept.withColumn("usable", F.size("ints") == width)


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows of a list column as ``(rows, parts, width)``."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1) if len(flat) else np.zeros((len(column), parts, 0), np.int64)


def _blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def first_entries(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """``(parts, entries, width)``: the parts of the vectors with the smallest keys, one vector a key."""
    usable = kept.filter("usable AND key IS NOT NULL").select("key", "ints")
    # each key's smallest vector among the rows with the smallest keys; the join side has ``entries`` rows
    keys = usable.select("key").distinct().orderBy("key").limit(entries)
    rows = usable.join(F.broadcast(keys), "key", "left_semi").groupBy("key").agg(F.min("ints").alias("ints")).orderBy("key").collect()
    width = len(rows[0]["ints"]) // parts if rows else 0
    start = np.array([r["ints"] for r in rows], np.int64).reshape(len(rows), parts, width)
    return np.ascontiguousarray(start.transpose(1, 0, 2))


def _sums(kept: DataFrame, books: np.ndarray) -> list:
    """``(part, entry, n, sums)`` of the parts that each entry is nearest to."""
    parts, entries, width = books.shape

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for block in _blocks(stream):
            x = _matrix(block.column(0), parts)
            for p in range(parts):
                best, _ = nearest(x[:, p], books[p])
                counts[p] += np.bincount(best, minlength=entries)
                order = np.argsort(best, kind="stable")
                chosen, starts = np.unique(best[order], return_index=True)
                sums[p, chosen] += np.add.reduceat(x[order, p], starts, axis=0)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.record_batch([
                pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
                pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    told = kept.filter("usable").select("ints").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.get("sums", F.lit(i))) for i in range(width)]
    return told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*total).alias("sums")).collect()


def codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The final entries, ``(parts, entries, width)``."""
    books = first_entries(kept, parts, entries)
    for _ in range(rounds if books.size else 0):
        for row in _sums(kept, books):
            books[row["part"], row["entry"]] = np.array(row["sums"], np.int64) // row["n"]  # floors down
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encoded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``(key, label, code, error)`` of each kept row."""
    parts = books.shape[0]

    def code(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(stream):
            usable = block.column(3).to_numpy(zero_copy_only=False) & (books.shape[1] > 0)
            codes, errors = np.zeros((len(usable), parts), np.int64), np.zeros(len(usable), np.int64)
            if usable.any():
                x = _matrix(block.column(2).filter(pa.array(usable)), parts)
                for p in range(parts):
                    best, far = nearest(x[:, p], books[p])
                    codes[usable, p] = best
                    errors[usable] += far
            texts = ["".join(f"{c:02x}" for c in row) if u else None for row, u in zip(codes.tolist(), usable.tolist())]
            yield pa.record_batch([block.column(0), block.column(1), pa.array(texts, pa.string()),
                                   pa.array(errors, pa.int64(), mask=~usable)], names=["key", "label", "code", "error"])

    schema = kept.select("key", "label").schema.add("code", "string").add("error", "long")
    return kept.select("key", "label", "ints", "usable").mapInArrow(code, schema)


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(key, label, code, error, label_error)`` of each kept row, and the codebooks.

    ``entries`` is at most 256 (two hex digits). ``label_error`` is null where no row of the label has a code.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = quantized(vectors, key, vector, label, scale, parts)
    books = codebooks(kept, parts, entries, rounds)
    coded = stage(encoded(kept, books), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books
