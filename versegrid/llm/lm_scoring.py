"""Text scores from a word n-gram model with deleted interpolation.

p(w | h) = l2 c(h w) / c(h) + l1 c(w) / N + l0 / (V + 1), where the weights l belong to the
size class of c(h), the power of two it reaches. They are learned by expectation
maximisation on held-out counts: every training token is scored with itself taken out of
all counts, as if it were the one deleted part (leave one out). For that, tokens of like
probabilities are counted together on a grid of ``STEP`` in log10; the grid is bounded
and goes to the driver, the counts are exact and cover all training tokens.

Words and pairs are too many to join one by one, so Spark moves them in packs. Documents
form blocks of about ``BLOCK`` tokens. A block sends, per bucket of the 64-bit hash range, one
row with all its distinct hashes and training counts; a bucket's task adds them up and
sends each block the totals for just the hashes it asked about, in the order it asked.
A word in every document is one hash per block, so there are no hot keys. The number of
buckets grows with the number of hashes, so a task holds about ``BUCKET`` of them.

Defined cases: a null or empty text is the end token alone. Repeated rows count each. A
null key is kept. Without training documents all scores are 0. Empty tables give no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versegrid.session import drop_staged, stage

BLOCK = 1 << 20
BUCKET = 1 << 21
STEP = 0.05
CLASSES = 64
LOW = np.uint64((1 << 48) - 1)
START, END = np.uint64(1), np.uint64(2)
KEPT_WORDS = 400_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_known: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words and the end token, behind the start mark."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if len(_known) > KEPT_WORDS:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = START, END
    out[1:-1] = [_known[w] for w in words]
    return out


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    value = (first ^ (first >> np.uint64(31))) * _M1 + second
    value = (value ^ (value >> np.uint64(29))) * _M2
    return value ^ (value >> np.uint64(32))


def _pack(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, one byte plane after the other, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts of any size: low and high halves."""
    return _pack(np.concatenate([counts & 0xFFFFFFFF, counts >> 32]))


def _unpack_counts(data: bytes) -> np.ndarray:
    halves = _unpack(data).astype(np.int64).reshape(2, -1)
    return halves[0] | halves[1] << 32


def _short(hashes: np.ndarray) -> bytes:
    """The low 48 bits, each as its distance to the one before: hashes of one bucket in the order of these bits are close together.

    A bucket has some two million hashes however large the corpus, so no two of it are likely to agree.
    """
    low = hashes & LOW
    return _pack_steps(np.diff(low, prepend=np.uint64(0)), 6)


def _long(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack_steps(data, 6), dtype=np.uint64)


def _pack_steps(steps: np.ndarray, octets: int) -> bytes:
    planes = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :octets].T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack_steps(data: bytes, octets: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(octets, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :octets] = planes.T
    return steps.view("<u8").reshape(-1)


def blocks(docs: DataFrame, key: str, text: str, held_out: Column, size: int = BLOCK) -> DataFrame:
    """``(block, keys, held_out, lengths, words, stream, n_keys)``: documents as numbers into the block's own sorted hashes."""
    rows = docs.select(F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def build(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, flags, parts, tokens, key_type = 0, [], [], [], 0, None

        def made() -> pa.RecordBatch:
            words, index = np.unique(np.concatenate(parts), return_inverse=True)
            codes = _pair_codes(index, [len(p) for p in parts], len(words))
            return pa.record_batch([
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()), pa.array([keys], pa.list_(key_type)),
                pa.array([flags], pa.list_(pa.bool_())), pa.array([[len(p) - 1 for p in parts]], pa.list_(pa.int32())),
                pa.array([_pack_steps(np.diff(words, prepend=np.uint64(0)), 8)], pa.binary()), pa.array([_pack(index)], pa.binary()),
                pa.array([len(words) + len(np.unique(codes))], pa.int64())],
                names=["block", "keys", "held_out", "lengths", "words", "stream", "n_keys"])

        for batch in stream:
            key_type = batch.schema.field(0).type
            for k, h, t in zip(*[c.to_pylist() for c in batch.columns]):
                parts.append(word_hashes(t))
                keys.append(k), flags.append(h)
                tokens += len(parts[-1])
                if tokens >= size:
                    yield made()
                    number, keys, flags, parts, tokens = number + 1, [], [], [], 0
        if parts:
            yield made()

    return rows.mapInArrow(build, f"block long, keys array<{kind}>, held_out array<boolean>, lengths array<int>, "
                                  "words binary, stream binary, n_keys long")


def _starts(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))[:-1]])


def _pair_codes(index: np.ndarray, parts: list[int], n: int) -> np.ndarray:
    """One number per token for the pair it forms with the token before; the start mark only comes first."""
    code = index[:-1].astype(np.int64) * n + index[1:]
    return np.delete(code, _starts(parts)[1:] - 1)


class Block:
    """One block's documents as arrays."""

    def __init__(self, row: dict):
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.words = np.cumsum(_unpack_steps(row["words"], 8), dtype=np.uint64)
        self.held_out = np.asarray(row["held_out"], bool)
        index, parts = _unpack(row["stream"]), self.lengths + 1
        self.pairs, self.pair = np.unique(_pair_codes(index, parts, len(self.words)), return_inverse=True)
        self.word = np.delete(index, _starts(parts))
        self.trains = np.repeat(~self.held_out, self.lengths)

    def asked(self, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of one order, the places that sort them by bucket and low bits, and where each bucket begins."""
        if order == 1:
            hashes = self.words
        else:
            hashes = pair_hashes(self.words[self.pairs // len(self.words)], self.words[self.pairs % len(self.words)])
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        if buckets <= 1 << 16:  # one number to sort by
            places = np.argsort(bucket << np.uint64(48) | hashes & LOW)
        else:
            places = np.lexsort((hashes & LOW, bucket))
        return hashes, places, np.searchsorted(bucket[places], np.arange(buckets + 1, dtype=np.uint64))

    def training_counts(self, order: int) -> np.ndarray:
        if order == 2:
            return np.bincount(self.pair[self.trains], minlength=len(self.pairs))
        counts = np.bincount(self.word[self.trains], minlength=len(self.words))
        counts[np.searchsorted(self.words, START)] += int((~self.held_out).sum())
        return counts


def _asked_rows(stored: DataFrame, buckets: int) -> DataFrame:
    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                block = Block(row)
                for order in (1, 2):
                    hashes, places, bounds = block.asked(order, buckets)
                    hashes, counts = hashes[places], block.training_counts(order)[places]
                    full = np.flatnonzero(np.diff(bounds))
                    cut = [slice(bounds[i], bounds[i + 1]) for i in full]
                    yield pa.record_batch([
                        pa.array([row["block"]] * len(full), pa.int64()), pa.array([order] * len(full), pa.int32()),
                        pa.array(full, pa.int64()), pa.array([_short(hashes[c]) for c in cut], pa.binary()),
                        pa.array([_pack(counts[c]) for c in cut], pa.binary())],
                        names=["block", "order", "bucket", "hashes", "counts"])

    return stored.select("block", "held_out", "lengths", "words", "stream").mapInArrow(
        ask, "block long, order int, bucket long, hashes binary, counts binary")


def _answers(asked: DataFrame) -> DataFrame:
    """``(block, order, bucket, counts, distinct)``: totals per asked hash; ``distinct`` words once per bucket."""
    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_long(h) for h in pdf["hashes"]]
        unique, place = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.concatenate([_unpack(c) for c in pdf["counts"]])
        total = np.bincount(place, counts, len(unique)).astype(np.int64)
        seen = int(((total > 0) & (unique != START)).sum()) if pdf["order"].iloc[0] == 1 else 0
        ends = np.cumsum([len(p) for p in parts])
        answers = [_pack_counts(total[place[e - len(p):e]]) for e, p in zip(ends, parts)]
        return pd.DataFrame({"block": pdf["block"], "order": pdf["order"], "bucket": pdf["bucket"], "counts": answers,
                             "distinct": [seen] + [0] * (len(parts) - 1)})

    return asked.groupBy("order", "bucket").applyInPandas(
        add_up, "block long, order int, bucket long, counts binary, distinct long")


def _with_counts(joined: DataFrame, kind: str, buckets: int) -> DataFrame:
    """Per block its documents, the count of the start mark, and per token the counts of the word and of its pair with the one before.

    ``distinct`` adds up to the number of distinct training words over all blocks.
    """
    def put(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                (values,) = row.drop_columns(["keys"]).to_pylist()
                block, totals = Block(values), []
                for order in (1, 2):
                    hashes, places, _ = block.asked(order, buckets)
                    parts = sorted((a["bucket"], a["counts"]) for a in values["answers"] if a["order"] == order)
                    total = np.empty(len(hashes), np.int64)
                    total[places] = np.concatenate([_unpack_counts(c) for _, c in parts])
                    totals.append(total)
                start = int(totals[0][np.searchsorted(block.words, START)])
                yield pa.RecordBatch.from_arrays(
                    [row.column("keys"), row.column("held_out"), row.column("lengths"),
                     pa.array([start], pa.int64()), pa.array([_pack_counts(totals[0][block.word])], pa.binary()),
                     pa.array([_pack_counts(totals[1][block.pair])], pa.binary()),
                     pa.array([sum(a["distinct"] for a in values["answers"])], pa.int64())],
                    names=["keys", "held_out", "lengths", "start", "word", "pair", "distinct"])

    return joined.mapInArrow(put, f"keys array<{kind}>, held_out array<boolean>, lengths array<int>, "
                                  "start long, word binary, pair binary, distinct long")


def _counted(row: dict) -> tuple[np.ndarray, ...]:
    """Lengths, which documents are held out, and per token the counts of the word, of the word before, and of their pair."""
    lengths, word = np.asarray(row["lengths"], np.int64), _unpack_counts(row["word"])
    before = np.concatenate([[0], word[:-1]])
    before[_starts(lengths)] = row["start"]
    return lengths, np.asarray(row["held_out"], bool), word, before, _unpack_counts(row["pair"])


def _size_class(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.frexp(count.astype(np.float64))[1], 0)


def held_out_counts(counted: DataFrame, n: int) -> DataFrame:
    """``(class, q2, q1, n)``: training tokens by size class and grid cell of both estimates, each token left out; -1 is zero."""
    def grid(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(p > 0, np.rint(-np.log10(p) / STEP), -1).astype(np.int64)

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                lengths, held_out, word, before, pair = _counted(row)
                t = np.repeat(~held_out, lengths)
                word, before, pair = word[t] - 1, before[t] - 1, pair[t] - 1
                q2 = grid(np.where(before > 0, pair / np.maximum(before, 1), 0))
                q1 = grid(word / max(n - 1, 1))
                cells, number = np.unique(np.stack([_size_class(before), q2, q1]), axis=1, return_counts=True) \
                    if len(q1) else (np.empty((3, 0), np.int64), np.empty(0, np.int64))
                yield pa.record_batch([*[pa.array(c, pa.int64()) for c in cells], pa.array(number, pa.int64())],
                                      names=["class", "q2", "q1", "n"])

    return counted.drop("keys", "distinct").mapInArrow(count, "class long, q2 long, q1 long, n long").groupBy("class", "q2", "q1").agg(F.sum("n").alias("n"))


def learned_weights(cells: list, vocabulary: int) -> np.ndarray:
    """Weights ``(l2, l1, l0)`` per size class by expectation maximisation until they stay the same.

    A class without held-out tokens takes the weights of the next smaller one.
    """
    weights = np.zeros((CLASSES + 1, 3))
    last = np.array([0.0, 0.5, 0.5])
    table = np.array([tuple(c) for c in cells], np.float64).reshape(-1, 4)
    for k in range(CLASSES + 1):
        own = table[table[:, 0] == k]
        if len(own):
            p = np.stack([np.where(own[:, 1] >= 0, 10 ** (-STEP * own[:, 1]), 0),
                          np.where(own[:, 2] >= 0, 10 ** (-STEP * own[:, 2]), 0),
                          np.full(len(own), 1 / (vocabulary + 1))], 1)
            now, before = np.full(3, 1 / 3), np.zeros(3)
            while np.abs(now - before).max() > 1e-7:
                share = now * p
                before, now = now, (own[:, 3, None] * share / share.sum(1, keepdims=True)).sum(0) / own[:, 3].sum()
            last = np.maximum(now, 1e-9) / np.maximum(now, 1e-9).sum()
        weights[k] = last
    return weights


def scored(counted: DataFrame, kind: str, n: int, vocabulary: int, weights: np.ndarray) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, base_score, score)`` per document."""
    base = log10(n + vocabulary + 1)

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i, row in enumerate(batch.to_pylist()):
                lengths, held_out, word, before, pair = _counted(row)
                at = _starts(lengths)
                own = weights[_size_class(before)]
                p = own[:, 0] * pair / np.maximum(before, 1) + own[:, 1] * word / max(n, 1) + own[:, 2] / (vocabulary + 1)
                if not n:
                    p = np.ones(len(p))
                yield pa.record_batch([
                    batch.column(batch.schema.get_field_index("keys"))[i].values, pa.array(held_out, pa.bool_()),
                    pa.array(lengths, pa.int64()), pa.array(np.add.reduceat((word > 0).astype(np.int64), at), pa.int64()),
                    pa.array(np.add.reduceat(np.log10(word + 1.0) - base, at), pa.float64()),
                    pa.array(np.add.reduceat(np.log10(p), at), pa.float64())],
                    names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return counted.drop("distinct").mapInArrow(score, f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text",
                    block: int = BLOCK) -> DataFrame:
    """Scores of all documents by a model of those that are not ``held_out``; also ``train_tokens``."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    stored = stage(blocks(docs, key, text, held_out, block), "lm-blocks")
    training = F.aggregate(F.arrays_zip("held_out", "lengths"), F.lit(0).cast("long"),
                           lambda a, x: a + F.when(x["held_out"], 0).otherwise(x["lengths"]))
    sums = stored.agg(F.sum("n_keys").alias("keys"), F.sum(training).alias("n")).first()
    n = sums["n"] or 0
    buckets = max(ceil((sums["keys"] or 0) / BUCKET), spark.sparkContext.defaultParallelism)
    packs = _answers(_asked_rows(stored, buckets)).groupBy("block").agg(
        F.collect_list(F.struct("order", "bucket", "counts", "distinct")).alias("answers"))
    counted = stage(_with_counts(stored.drop("n_keys").join(packs, "block"), kind, buckets), "lm-counted")
    drop_staged(stored)
    vocabulary = counted.agg(F.sum("distinct")).first()[0] or 0
    # at most CLASSES x (20 / STEP) ^ 2 cells
    cells = held_out_counts(counted, n).select("class", "q2", "q1", "n").collect()
    weights = learned_weights(cells, vocabulary)
    return scored(counted, kind, n, vocabulary, weights).withColumn("train_tokens", F.lit(n).cast("long"))
