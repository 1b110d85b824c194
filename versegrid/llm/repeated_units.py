"""Repeated lines and sentences, removed wherever they are not the first.

Units are the lines of a text, of any length, and the sentences inside lines, as passages
are pasted into the middle of lines, whose own digest then says nothing. A sentence has
``LEAST`` words or more, or five characters for each of these (long words), or two for
each in a script without spaces. Sentences end at the stops of any script, and at blanks
inside Thai, Lao, Khmer and Burmese, which have no other. A unit is normalised (lower case, single spaces) and named by 128 bits of its hash.
Digests are counted globally with partial sums; the occurrence in the smallest
document, and there the first one, is kept. All others are removed, with their offsets
in the original text.

A digest that occurs everywhere is one row per task before the shuffle. Its occurrences
are never gathered: the kept one joins back to them, and AQE splits that key. Units that
occur once are held back by a bit map of the repeated digests and not shuffled again.

Defined cases: null and empty texts have no units, nor have blank lines. A null id ranks last. Rows repeated
with one id count as one document: what is kept in one is kept in all. Ties cannot
occur, as a unit starts at one offset of a document once. Empty tables give no rows.
Other columns are ignored, or kept by :func:`cleaned`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versegrid.llm.common import fresh, reduced
from versegrid.session import stage

LEAST = 8
LINE = re.compile(r"[^\n]+")
#: Thai, Lao, Burmese and Khmer.
PHRASED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
#: Scripts without spaces between words: those, Tibetan, kana, Bopomofo and Han.
UNSPACED = re.compile(f"[{PHRASED}\u0f00-\u0fff\u3005-\u3007\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: Closing marks that belong to the sentence before them.
CLOSING = "[\"')\\]\u00bb\u2019\u201d\u3009\u300b\u300d\u300f\u3011\uff09\uff63]*"
#: Latin stops need a blank behind them, as they also stand inside numbers and names; the others do not.
SENTENCE_END = re.compile(
    rf"[.!?]+{CLOSING}(?=\s)"
    "|[\u3002\uff01\uff0e\uff1f\uff61\u0589\u061f\u06d4\u0700-\u0702\u0964\u0965\u0f0d\u0f0e\u104a\u104b\u1362\u1367\u1368\u17d4\u17d5\u1803\u1809]+" + CLOSING
    + f"|(?<=[{PHRASED}])(?=[ \t]+[{PHRASED}])")


def _long_enough(raw: str, words: list[str], least: int) -> bool:
    return len(words) >= least or sum(map(len, words)) >= 5 * least or (
        not raw.isascii() and len(UNSPACED.findall(raw)) >= 2 * least)


def spans(text: str, least: int = LEAST) -> Iterator[tuple[int, int, int, int, bytes]]:
    """``(start, stop, line start, words, whole line or not, digest)`` of each unit, offsets in code points."""
    for line in LINE.finditer(text):
        low, high = line.span()
        cuts = [low, *[m.end() for m in SENTENCE_END.finditer(text, low, high)], high]
        pieces = list(zip(cuts, cuts[1:])) if len(cuts) > 2 else []
        for whole, (start, stop) in [(True, (low, high)), *((False, p) for p in pieces)]:
            raw = text[start:stop]
            words = raw.split()
            if words and (whole or _long_enough(raw, words, least)):
                start += len(raw) - len(raw.lstrip())
                yield start, stop, low, len(words), whole, xxhash.xxh3_128_digest(" ".join(words).lower().encode("utf-8", "surrogatepass"))


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, start, stop, line, words, whole, h1, h2)`` with one row per unit of each document."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = list(spans(t or "", least))
                found += own
                rows += [i] * len(own)
            digest = np.frombuffer(b"".join([u[5] for u in found]), np.int64).reshape(-1, 2)
            yield pa.record_batch([
                batch.column(0).take(pa.array(rows, pa.int64())),
                *[pa.array([u[c] for u in found], pa.int32()) for c in range(4)],
                pa.array([u[4] for u in found], pa.bool_()), pa.array(digest[:, 0]), pa.array(digest[:, 1])],
                names=["doc_id", "start", "stop", "line", "words", "whole", "h1", "h2"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        batches, f"doc_id {kind}, start int, stop int, line int, words int, whole boolean, h1 long, h2 long")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, start, stop, words, kept_doc_id, kept_start)`` per unit that goes; sentences of a line that goes are left out."""
    every = units(docs, key, text, least)
    again = stage(every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("kept_doc_id")).filter("n > 1").select(
        "h1", "h2", "kept_doc_id", F.xxhash64("h1", "h2").alias("h")), "unit-repeats")
    near = reduced(every.withColumn("h", F.xxhash64("h1", "h2")), "h", again, "h").drop("h")
    found = stage(near.join(again.drop("h"), ["h1", "h2"]), "unit-occurrences")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("kept_doc_id"))).groupBy("h1", "h2").agg(F.min("start").alias("kept_start"))
    is_first = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") == F.col("kept_start"))
    gone = stage(found.join(first, ["h1", "h2"]).filter(~is_first), "unit-removed")
    lines = gone.filter("whole").select(F.col("doc_id").alias("line_doc"), F.col("line").alias("line_at")).distinct()
    inside = F.col("doc_id").eqNullSafe(F.col("line_doc")) & (F.col("line") == F.col("line_at"))
    parts = gone.filter("NOT whole").join(lines, inside, "left_anti")
    return gone.filter("whole").unionByName(parts).select("doc_id", "start", "stop", "words", "kept_doc_id", "kept_start")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` without its repeated units, and ``removed``, an array of their (start, stop) in the original text.

    A column named ``removed`` is replaced. One document's spans, no more than it has
    units, meet in one row.
    """
    at = fresh(docs, "removed_doc")
    gone = repeated(docs, key, text, least).groupBy(F.col("doc_id").alias(at)).agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(f"{at}_spans"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    joined = docs.drop("removed").join(gone, F.col(key).eqNullSafe(F.col(at)), "left").withColumn(
        "removed", F.coalesce(f"{at}_spans", none)).drop(at, f"{at}_spans")
    # what stays, from the end of each span to the start of the next
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))
    upto = lambda a, to: F.concat(a["kept"], F.substring(F.col(text), a["at"] + 1, F.greatest(to - a["at"], F.lit(0))))
    rest = F.aggregate(
        F.col("removed"), state.cast("struct<at:int,kept:string>"),
        lambda a, r: F.struct(F.greatest(a["at"], r["stop"]).alias("at"), upto(a, r["start"]).alias("kept")),
        lambda a: upto(a, F.length(text)))
    return joined.withColumn(text, F.when(F.size("removed") > 0, rest).otherwise(F.col(text)))
