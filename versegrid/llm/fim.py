"""Fill-in-middle transformation by in-place block rotation, and its exact inverse.

A text is cut at two of its unit bounds into prefix, middle and suffix. Units are
white space with the word behind it, or the white space at the end. Cuts, the choice of
rows and their form come from the sha256 of seed and key, so reruns agree. The work of a
row is done in one byte buffer: bounds are scanned, sentinels inserted before the three
segments, and the segments put in order by rotations of three reversals each:

* ``psm``: ``<P>prefix<S>suffix<M>middle``, middle and suffix change places;
* ``spm``: ``<S>suffix<P>prefix<M>middle``, the suffix goes to the front;
* ``plain``: the text as it is.

``restored`` finds the sentinels, makes the same rotation backwards and takes them out. It
needs output and form alone. A text that holds a sentinel stays plain, and as no
sentinel starts inside another, each stands once in an output.

Rows are independent: nothing is shuffled, a lost task is simply run again, and a
reversal moves ``BLOCK`` bytes at a time, so a row costs its own length and little more.

Defined cases: a null text is empty; an empty text is plain with 0 units. A null key
counts as the empty text. Rows repeated with one key are cut alike. Malformed UTF-8 is
carried as bytes. Columns of the documents stay; one named like the added column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versegrid.llm.common import fresh

#: Fixed sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Percent of rows that are transformed, and percent of those in form spm.
RATE, SPM_RATE = 50, 80
BLOCK = 1 << 16
#: Bytes of output handed on at once.
HANDED = 8 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets behind the units of a text."""
    if not len(data):
        return np.empty(0, np.int64)
    space = _SPACE[data]
    return np.flatnonzero(~space & np.append(space[1:], True)) + 1 if not space[-1] else np.append(
        np.flatnonzero(~space[:-1] & space[1:]) + 1, len(data))


def reverse(buffer: bytearray, start: int, end: int) -> None:
    """Reverse ``buffer[start:end]`` in place, swapping blocks from both ends."""
    view = np.frombuffer(buffer, np.uint8)
    while end - start > 1:
        k = min(BLOCK, (end - start) // 2)
        held = view[start:start + k].copy()
        view[start:start + k] = view[end - k:end][::-1]
        view[end - k:end] = held[::-1]
        start, end = start + k, end - k


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbouring segments ``[start, middle)`` and ``[middle, end)`` by three reversals."""
    reverse(buffer, start, middle)
    reverse(buffer, middle, end)
    reverse(buffer, start, end)


def transformed(data: bytes, first: int, second: int, form: str) -> bytes:
    """The text with cuts behind ``first`` and ``second`` bytes, in the given form."""
    if form == "plain":
        return data
    buffer = bytearray(data)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):  # from the back, so that offsets hold
        buffer[at:at] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return bytes(buffer)


def restored(output: bytes, form: str) -> bytes:
    """The text that gave ``output``."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    moved, last = (SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX)
    start, middle = buffer.index(moved), buffer.index(last)
    rotate(buffer, start, middle, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.rindex(sentinel)
        del buffer[at:at + len(sentinel)]
    return bytes(buffer)


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _draws(key: Column, seed: int) -> Column:
    """Four numbers below 2^32 from the sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _handed(rows: Iterator[tuple], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of some ``HANDED`` bytes; the size of a row is that of its bytes values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, bytes))
        if size >= HANDED:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE,
                   spm_rate: int = SPM_RATE, name: str = "fim") -> DataFrame:
    """``docs`` with a struct ``name`` of (n, form, prefix_chars, middle_chars, output); lengths are null if plain."""
    def one(data: bytes, h: list[int]) -> tuple:
        view = np.frombuffer(data, np.uint8)
        ends = unit_ends(view)
        n = len(ends)
        if not data or h[2] % 100 >= rate or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, data
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        first, second = (int(ends[c - 1]) if c else 0 for c in (low, high))
        form = "spm" if h[3] % 100 < spm_rate else "psm"
        return n, form, _code_points(view[:first]), _code_points(view[first:second]), transformed(data, first, second, form)

    names, types = ["n", "form", "prefix_chars", "middle_chars", "output"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    kept = [c for c in docs.columns if c != name]
    data, draws = fresh(docs, "fim_data"), fresh(docs, "fim_draws")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = 0
            values = zip(batch.column(len(kept)), batch.column(len(kept) + 1))
            for made in _handed((one(d.as_py(), h.as_py()) for d, h in values), names, types):
                own = batch.slice(at, made.num_rows)
                at += made.num_rows
                yield pa.record_batch([*own.columns[:len(kept)], *made.columns], names=[*kept, *[f"{data}_{n}" for n in names]])

    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(data), _draws(F.col(key), seed).alias(draws))
    schema = docs.select(*kept).schema
    for n, kind in zip(names, ("long", "string", "long", "long", "binary")):
        schema = schema.add(f"{data}_{n}", kind)
    made = {n: F.col(f"{data}_{n}").alias(n) for n in names} | {"output": F.col(f"{data}_output").cast("string").alias("output")}
    return rows.mapInArrow(batches, schema).select(*kept, F.struct(*[made[n] for n in names]).alias(name))


def restore(rows: DataFrame, output: Column, form: Column, name: str = "restored") -> DataFrame:
    """``rows`` with the text that gave ``output``; a null output gives an empty text."""
    kept = [c for c in rows.columns if c != name]
    made, kind = fresh(rows, "fim_output"), fresh(rows, "fim_form")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = 0
            values = zip(batch.column(len(kept)), batch.column(len(kept) + 1))
            for back in _handed(((restored(o.as_py() or b"", f.as_py()),) for o, f in values), [name], [pa.binary()]):
                own = batch.slice(at, back.num_rows)
                at += back.num_rows
                yield pa.record_batch([*own.columns[:len(kept)], back.column(0)], names=[*kept, name])

    given = rows.select(*kept, output.cast("binary").alias(made), form.alias(kind))
    return given.mapInArrow(batches, rows.select(*kept).schema.add(name, "binary")).withColumn(name, F.col(name).cast("string"))
