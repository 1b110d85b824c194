"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram is
bound from its three letters' vectors, the first shifted by two places and the second by
one, multiplied element by element. A text is the bundle, the sum, of its trigrams; a
language's prototype is the sum of the normalised bundles of its labelled documents.
The prediction is the language whose prototype has the largest cosine with the text,
both less the mean of all prototypes, which takes out what languages share.

Training is one pass that keeps a sum per language in each task; the sums are integers,
so their order does not matter, and are added up per component. The prototypes are
brought to the driver: ``DIMENSIONS`` numbers a language, and a number of languages
above ``MOST_LANGUAGES`` is an error. Prediction needs no shuffle.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as are all
texts if no label is known; rows without a label do not train. Of languages that are
equally near the first in code point order is taken. Repeated rows each count. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versegrid.session import stage

DIMENSIONS = 1024
MOST_LANGUAGES = 4096
UNKNOWN = "und"
#: Code points below are letters of their own, those above share the other ``LETTERS`` - ``DIRECT`` vectors.
DIRECT = 0x250
LETTERS = 1024
#: Bundles are scaled to this length and rounded, so that sums are exact.
UNIT = 1 << 20
#: Cosines are rounded to one part in this many for the cut-offs, so that sums are exact.
GRAIN = 4096
#: Fewest labelled documents that a cut-off is taken from.
ENOUGH = 16
#: Trigrams bound at once.
BLOCK = 2048

_tables: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Number of the vector of each code point; 0 is everything that is no letter."""
    if "letters" not in _tables:
        numbers = np.zeros(0x110000, np.int16)
        for code in range(0x110000):
            if chr(code).isalpha():
                numbers[code] = code if code < DIRECT else DIRECT + code * 2654435761 % 4294967296 % (LETTERS - DIRECT)
        _tables["letters"] = numbers
    return _tables["letters"]


def _vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors shifted by two, one and no places."""
    if "shift0" not in _tables:
        draw = np.random.Generator(np.random.PCG64(8)).integers(0, 2, (LETTERS, DIMENSIONS), np.int8) * 2 - 1
        for k in range(3):
            _tables[f"shift{k}"] = np.ascontiguousarray(np.roll(draw, k, axis=1).astype(np.int8))
    return _tables["shift2"], _tables["shift1"], _tables["shift0"]


def bundle(text: str | None) -> np.ndarray | None:
    """The unit-length bundle of a text's trigrams; None without letters. Runs of other characters count as one gap."""
    return _sized_bundle(text)[0]


def _sized_bundle(text: str | None) -> tuple[np.ndarray | None, int]:
    """The bundle, and the number of its distinct trigrams."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letter_table()[codes].astype(np.int64)
    if not letters.any():
        return None, 0
    letters = np.concatenate([[0], letters, [0]])
    letters = letters[np.concatenate([[True], (letters[1:] != 0) | (letters[:-1] != 0)])]
    grams, counts = np.unique((letters[:-2] * LETTERS + letters[1:-1]) * LETTERS + letters[2:], return_counts=True)
    two, one, none = _vectors()
    total = np.zeros(DIMENSIONS, np.float64)
    for i in range(0, len(grams), BLOCK):
        g = grams[i:i + BLOCK]
        bound = two[g // (LETTERS * LETTERS)] * one[g // LETTERS % LETTERS] * none[g % LETTERS]
        total += counts[i:i + BLOCK].astype(np.float32) @ bound.astype(np.float32)
    length = np.linalg.norm(total)
    return (total / length, len(grams)) if length else (None, 0)


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A unit-length prototype per language of the labelled documents, less the mean of all."""
    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in stream:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (own := bundle(t)) is not None:
                    total[name] = total.get(name, 0) + np.rint(own * UNIT).astype(np.int64)
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.int64()))],
                              names=["lang", "v"])

    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    parts = labelled.mapInArrow(sums, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    summed = stage(parts.groupBy("lang", "i").agg(F.sum("x").alias("x")), "language-sums")
    if (n := summed.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} or more languages")
    found: dict[str, np.ndarray] = {}
    for row in summed.collect():  # DIMENSIONS numbers for each of at most MOST_LANGUAGES languages
        found.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["i"]] = row["x"]
    unit = {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(found.items())}
    mean = sum(unit.values()) / len(unit) if len(unit) > 1 else 0
    return {k: v - mean for k, v in unit.items()} | ({"": mean} if len(unit) > 1 else {})


def _judge(learned: dict[str, np.ndarray]):
    """A function from a text to its language and score, its plain cosine (no mean taken out) and its number of distinct trigrams."""
    names = [n for n in learned if n]
    matrix = np.array([learned[n] / (np.linalg.norm(learned[n]) or 1) for n in names])
    mean = learned.get("")
    plain = [learned[n] + (0 if mean is None else mean) for n in names]

    def judge(text: str | None) -> tuple[str, float, float, int]:
        whole, size = _sized_bundle(text) if names else (None, 0)
        if whole is None:
            return UNKNOWN, 0.0, 0.0, 0
        own = whole if mean is None else whole - mean
        near = matrix @ own / (np.linalg.norm(own) or 1)
        k = int(near.argmax())
        return names[k], float(min(1.0, max(0.0, near[k]))), float(plain[k] @ whole), size

    return judge


def cutoffs(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", lang: str = "lang") -> dict[tuple[str, int], float]:
    """Lowest plain cosine of a text per language and binary order of its number of distinct trigrams.

    From the labelled documents that are recognised as what they are: four deviations
    below their mean, or a third of the mean if that is less. Short and repetitive texts score low by nature,
    hence the orders. One with fewer than ``ENOUGH`` documents has the cut-off of the next
    smaller one that has them, as longer texts score higher, or half of the next larger
    one's for each order between. A language without any such order has no cut-off.
    """
    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, total = _judge(learned), {}
        for batch in stream:
            for label, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, _, plain, size = judge(t)
                if name == label and size:
                    n, x, xx = total.get((name, size.bit_length()), (0, 0, 0))
                    whole = round(plain * GRAIN)  # sums of integers do not depend on their order
                    total[name, size.bit_length()] = n + 1, x + whole, xx + whole * whole
        yield pa.record_batch([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()),
                               *[pa.array([v[i] for v in total.values()], pa.int64()) for i in range(3)]],
                              names=["lang", "size", "n", "x", "xx"])

    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    rows = labelled.mapInArrow(sums, "lang string, size long, n long, x long, xx long").groupBy("lang", "size").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx")).filter(F.col("n") >= ENOUGH)
    found = {}
    for r in rows.collect():  # at most 64 orders for each of at most MOST_LANGUAGES languages
        mean = r["x"] / r["n"]
        spread = max(0.0, r["xx"] / r["n"] - mean * mean) ** 0.5
        found[r["lang"], r["size"]] = min(mean - 4 * spread, mean / 3) / GRAIN
    filled = {}
    for name in {k for k, _ in found}:
        own = sorted(size for k, size in found if k == name)
        for size in range(1, 65):
            near = max((x for x in own if x <= size), default=own[0])
            filled[name, size] = found[name, near] * 0.5 ** max(0, near - size)
    return filled


def recognised(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", least: float = 0.0,
               lowest: dict[tuple[str, int], float] | None = None) -> DataFrame:
    """``docs`` without those of no known language.

    Those are texts without letters, and those whose plain cosine to the nearest
    prototype is below the cut-off in ``lowest`` (see :func:`cutoffs`), or ``least`` or
    below where that has none.
    """
    def keep(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(learned)
        for batch in stream:
            stay = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                name, _, plain, size = judge(t)
                low = (lowest or {}).get((name, size.bit_length()))
                stay.append(name != UNKNOWN and (plain > least if low is None else plain >= low))
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def predictions(docs: DataFrame, learned: dict[str, np.ndarray], key: str = "doc_id", text: str = "text",
                *kept: Column) -> DataFrame:
    """``(key, …kept, lang_pred, score)``; the score is the cosine, 0 where it is negative."""
    def predict(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(learned)
        for batch in stream:
            found = [judge(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                                   pa.array([f[1] for f in found], pa.float64())],
                                  names=[*batch.schema.names[:-1], "lang_pred", "score"])

    source = docs.select(key, *kept, F.col(text).alias("lang_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(predict, f"{schema}, lang_pred string, score double")
