"""Near-duplicate groups by b-bit MinHash.

1. A document is the set of its distinct word shingles. Documents with equal sets are
   one class, stood for by its smallest key; only classes are compared.
2. Of each class, ``BANDS`` x ``ROWS`` minima of hash functions are taken. Bands of full
   minima find candidates; of each minimum only its ``BITS`` low bits are kept and packed
   into a signature. A pair at the threshold of 0.8 misses all bands with probability
   (1 - 0.8^5)^48 = 5e-9.
3. A bucket of any size names four of its members, the first and last under two orders
   of the digests, and a class is paired with the four that come first among all its
   buckets. So a class gets four pairs this way, and groups of copies meet in the same
   members. Members of larger buckets are also dealt into groups of some ``DEALT`` members, in
   ``DEALS`` ways, and each is paired with the first and the last of its groups. So large groups
   of near copies become one component by a few pairs a member. Signatures are compared by bit counts, corrected for the bits that agree by
   chance; a pair goes on unless its estimate is more than ``SLACK`` below the threshold,
   six times the error of 240 minima, or the parities of the two sets differ in more places
   than sets at the threshold can: each shingle of one set only changes one of ``PARITIES``
   bits, so that bound is exact. Remaining pairs are confirmed on the full sets.
4. Confirmed links join classes into components. A bucket whose members are all in one
   component has nothing left to say. In the buckets that are left the pairs across components
   are still open. Small ones compare the signatures of all of them. The classes of large
   ones meet on their rarest shingles instead: of two sets at the threshold each has one of its
   ``n - ceil(0.8 n) + 1`` first shingles among the other's, in any order that is the same for
   all. Shingles that stand in one component only come first in that order, then rare
   ones, so a class with too few shingles outside its component meets nobody, and texts around
   one passage do not meet in it. That is exact: no pair is dropped for the size of its bucket.

All tables hold ids and hashes; texts travel for unconfirmed pairs only.

Defined cases: null texts and texts without words have an empty set and stand alone; a
text of fewer words than a shingle has its whole sequence as one. Rows repeated with
one key are one node, linked by either text. A null key is kept and stands for itself
(component null). Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from versegrid.llm.common import reduced, without
from versegrid.operators.cluster import connected_components
from versegrid.session import drop_staged, stage

SHINGLE = 5
THRESHOLD = 80
BANDS = 48
ROWS = 5
BITS = 2
#: Pairs whose estimated percentage is this far below the threshold are not confirmed (six standard errors).
SLACK = 20
#: Bits of the parities of a set.
PARITIES = 1024
#: Ways in which the members of buckets are dealt, and members of a group.
DEALS, DEALT = 3, 8
#: Buckets up to this many members list their open pairs at once.
SMALL = 32
#: Words whose hash a worker keeps before it starts anew, and the length up to which one is kept: some 16 MB.
KEPT_WORDS, KEPT_LENGTH = 100_000, 64
#: What two classes are compared by before their texts.
SIGNATURE = ("n_shingles", "planes", "odd")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_known: dict[bytes, int] = {}


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    try:
        ids = [_known[w] for w in words]
    except KeyError:
        if len(_known) > KEPT_WORDS:
            _known.clear()
        _known.update({w: xxhash.xxh64_intdigest(w) for w in set(words).difference(_known) if len(w) <= KEPT_LENGTH})
        ids = [_known[w] if w in _known else xxhash.xxh64_intdigest(w) for w in words]
    ids = np.array(ids, np.uint64)
    n = min(n, len(ids))
    value = np.full(len(ids) - n + 1, n, np.uint64)
    for j in range(n):
        value = (value ^ ids[j:len(ids) - n + 1 + j]) * _M1
        value ^= value >> np.uint64(29)
    value *= _M2
    return np.unique(value ^ (value >> np.uint64(32)))


def _parameters(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20240607))
    return draw.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, count, np.uint32)


def minima(hashes: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """``count`` minima of a non-empty set under as many hash functions, a block of the set at a time."""
    a, b = _parameters(count) if count != BANDS * ROWS else _OWN
    folded = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(folded), 1024):
        block = folded[i:i + 1024, None] * a + b
        block ^= block >> np.uint32(15)
        block *= np.uint32(0x2C1B3C6D)
        np.minimum(best, block.min(0), out=best)
    return best


_OWN = _parameters(BANDS * ROWS)


def packed(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The ``bits`` low bits of each minimum as 64-bit words, one zero-padded bit plane after the other."""
    planes = np.zeros((bits, -(-len(low) // 64) * 8), np.uint8)
    for k in range(bits):
        row = np.packbits((low >> np.uint32(k)).astype(np.uint8) & 1)
        planes[k, :len(row)] = row
    return planes.reshape(-1).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's members falls on each of ``PARITIES`` places, as 64-bit words."""
    places = (hashes * _M1) >> np.uint64(64 - PARITIES.bit_length() + 1)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``(key, n_shingles, class, bands, planes, odd)``: set size, digest of the set, band hashes, packed low bits, parities."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sizes, classes, bands, planes, odd = [], [], [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py(), shingle)
                sizes.append(len(hashes))
                if not len(hashes):
                    classes.append(None), bands.append(None), planes.append(None), odd.append(None)
                    continue
                low = minima(hashes)
                classes.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                groups = low.reshape(BANDS, ROWS).astype(np.uint64)
                value = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    value = (value ^ groups[:, r]) * _M1
                    value ^= value >> np.uint64(31)
                bands.append(value.view(np.int64))
                planes.append(packed(low))
                odd.append(parities(hashes))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()),
                                   *[pa.array(c, pa.list_(pa.int64())) for c in (bands, planes, odd)]],
                                  names=["key", "n_shingles", "class", "bands", "planes", "odd"])
        _known.clear()  # an idle worker keeps nothing

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        batches, f"key {kind}, n_shingles long, class binary, bands array<long>, planes array<long>, odd array<long>")


def estimate(a: Column, b: Column, count: int = BANDS * ROWS, bits: int = BITS) -> Column:
    """Estimated similarity of two signatures: share of minima whose low bits all agree, less chance agreement."""
    width, differ = -(-count // 64), F.lit(0)
    for w in range(width):
        unequal = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        for k in range(1, bits):
            unequal = unequal.bitwiseOR(F.get(a, F.lit(w + k * width)).bitwiseXOR(F.get(b, F.lit(w + k * width))))
        differ = differ + F.bit_count(unequal)
    chance = 1 / (1 << bits)
    return (1 - differ / F.lit(count) - chance) / (1 - chance)


def _likely(threshold: int) -> Column:
    return _parities_allow(threshold) & (100 * estimate(F.col("planes_a"), F.col("planes_b")) >= threshold - SLACK)


def _parities_allow(threshold: int) -> Column:
    """The sets differ in no more members than the threshold leaves; they differ in as many as their parities, or more."""
    differ = F.lit(0)
    for w in range(PARITIES // 64):
        differ = differ + F.bit_count(F.get("odd_a", F.lit(w)).bitwiseXOR(F.get("odd_b", F.lit(w))))
    return (100 + threshold) * differ <= (100 - threshold) * (F.col("n_shingles_a") + F.col("n_shingles_b"))


def _confirmed(likely: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full sets reach the threshold."""
    both = likely.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", "b", "text_b")

    def check(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in stream:
            linked = []
            for a, text_a, b, text_b in zip(*batch.columns):
                if a.as_py() != last[0]:
                    last = (a.as_py(), shingle_hashes(text_a.as_py(), shingle))
                other = shingle_hashes(text_b.as_py(), shingle)
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                linked.append(100 * common >= threshold * (len(last[1]) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))
        _known.clear()

    return both.mapInArrow(check, "a long, b long")


def _of_class(rows: DataFrame, shingle: int) -> DataFrame:
    """``(class, text)`` of the rows ``(class, digest, text)`` whose text has that digest; others have the key of one that has."""
    def keep(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            own = [xxhash.xxh3_128_digest(shingle_hashes(t.as_py(), shingle).tobytes()) == d.as_py() for d, t in zip(batch.column(1), batch.column(2))]
            yield batch.select(["class", "text"]).filter(pa.array(own, pa.bool_()))
        _known.clear()

    return rows.mapInArrow(keep, "class long, text string")


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with the component of ``node``, which is the node itself where nothing is linked."""
    known = labels.select(F.col("node").alias(node), F.col("root").alias(name))
    return df.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links)


def _halves_swapped(number: Column) -> Column:
    """The 32-bit halves of a class number exchanged: a second order, and its own inverse."""
    return F.shiftleft(number, 32).bitwiseOR(F.shiftrightunsigned(number, 32))


def _shared_buckets(level: DataFrame) -> DataFrame:
    """The rows of buckets with several classes, each with the four members its bucket names and their number."""
    swapped = _halves_swapped(F.col("class"))
    named = level.groupBy("bucket").agg(
        F.min("class").alias("low"), F.max("class").alias("high"),
        F.min(swapped).alias("low_swapped"), F.max(swapped).alias("high_swapped"), F.count("*").alias("members")).filter("low <> high")
    return level.join(named, "bucket")


def _star_pairs(level: DataFrame) -> DataFrame:
    """``(a, b)``: each class with the named members that come first among its buckets."""
    named = level.groupBy("class").agg(F.min("low").alias("n1"), F.max("high").alias("n2"),
                                       F.min("low_swapped").alias("n3"), F.max("high_swapped").alias("n4"))
    others = F.array("n1", "n2", _halves_swapped(F.col("n3")), _halves_swapped(F.col("n4")))
    return named.select("class", F.explode(others).alias("other")).filter("class <> other").select(
        F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def _dealt_pairs(level: DataFrame) -> DataFrame:
    """``(a, b)``: each class in a bucket of more than two with at most two others per deal.

    Buckets are dealt into groups by a hash that each deal changes. Of a group the first and the last member
    under the order of that hash are named, and a class takes those that come first and last among all its groups of a deal.
    """
    deals = level.filter("members > 2").select("bucket", "class", "members", F.explode(F.sequence(F.lit(1), F.lit(DEALS))).alias("deal"))
    place = F.pmod(F.xxhash64("class", "deal"), F.ceil(F.col("members") / DEALT))
    dealt = deals.select("class", "deal", F.xxhash64("bucket", "deal", place).alias("group"),
                         F.struct(F.xxhash64("class", -F.col("deal")).alias("drawn"), "class").alias("own"))
    named = dealt.groupBy("group").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high")
    taken = dealt.join(named, "group").groupBy("class", "deal").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return taken.select("class", F.explode(F.array("low.class", "high.class")).alias("other")).filter("class <> other").select(
        F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def _opened(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The stored ``(bucket, class, root, members)`` of the buckets in ``rows`` that several components share."""
    rooted = _labelled(rows.select("bucket", "class"), labels, "class", "root")
    state = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                         F.count("*").alias("members")).filter("low <> high")
    return stage(rooted.join(state.select("bucket", "members"), "bucket"), "near-open")


def _likely_pairs(pairs: DataFrame, one: DataFrame, threshold: int) -> DataFrame:
    """The stored pairs ``(a, b)`` whose sizes and signatures let them reach the threshold."""
    sides = [one.select(F.col("class").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in SIGNATURE]) for c in "ab"]
    return stage(pairs.join(sides[0], "a").join(sides[1], "b").filter(
        _sizes_allow(threshold) & _likely(threshold)).select("a", "b"), "near-pairs")


def _open_pairs(listed: DataFrame, one: DataFrame, threshold: int) -> DataFrame:
    """Likely pairs across components of the buckets in ``listed``; the join compares sizes and signatures and keeps what is likely."""
    rows = listed.select("bucket", "class", "root").join(one.select("class", *SIGNATURE), "class")
    sides = [rows.select("bucket", *[F.col(c).alias(f"{c}_{side}") for c in ("class", "root", *SIGNATURE)]) for side in "ab"]
    met = sides[0].join(sides[1], (sides[0]["bucket"] == sides[1]["bucket"]) & (F.col("root_a") < F.col("root_b"))
                        & _sizes_allow(threshold) & _likely(threshold))
    return met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def _sizes_allow(threshold: int) -> Column:
    """The smaller set is large enough to make up the threshold of the larger one."""
    return 100 * F.least("n_shingles_a", "n_shingles_b") >= threshold * F.greatest("n_shingles_a", "n_shingles_b")


def _shingle_rows(texts: DataFrame, shingle: int) -> DataFrame:
    """``(class, root, n_shingles, hash)`` per distinct shingle of the rows ``(class, root, text)``."""
    def explode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for number, root, text in zip(*batch.columns):
                hashes = shingle_hashes(text.as_py(), shingle)
                for i in range(0, len(hashes), 1 << 16):
                    part = hashes[i:i + (1 << 16)]
                    yield pa.record_batch([pa.array(np.full(len(part), n)) for n in (number.as_py(), root.as_py(), len(hashes))]
                                          + [pa.array(part.view(np.int64))], names=["class", "root", "n_shingles", "hash"])
        _known.clear()

    return texts.select("class", "root", "text").mapInArrow(explode, "class long, root long, n_shingles long, hash long")


def _first_shingles(rows: DataFrame, threshold: int) -> DataFrame:
    """``(class, root, n_shingles, hash, place)``: the shingles of each class that a linked class of another component may meet first."""
    among = rows.groupBy("hash").agg(F.count("*").alias("among"), F.min("root").alias("low"), F.max("root").alias("high"))
    outside = rows.join(among.filter("low <> high").select("hash", "among"), "hash")
    own = W.partitionBy("class")
    placed = outside.withColumn("place", F.col("n_shingles") - F.count("*").over(own)
                                + F.row_number().over(own.orderBy("among", "hash")))
    needed = F.expr(f"({threshold} * n_shingles + 99) div 100")
    return placed.filter(F.col("place") <= F.col("n_shingles") - needed + 1).select("class", "root", "n_shingles", "hash", "place")


def _rare_pairs(opened: DataFrame, one: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Likely pairs across components of the classes in ``opened``, which meet on their rarest shingles.

    The first shingle that two sets share leaves what stands behind it in both for the rest of what they share.
    """
    members = opened.groupBy("class").agg(F.min("root").alias("root"))
    rows = stage(_shingle_rows(texts.join(members, "class"), shingle), "near-shingles")
    first = stage(_first_shingles(rows, threshold).join(one.select("class", "planes", "odd"), "class"), "near-first")
    drop_staged(rows)
    sides = [first.select("hash", *[F.col(c).alias(f"{c}_{side}") for c in ("class", "root", "place", *SIGNATURE)]) for side in "ab"]
    behind = F.least(F.col("n_shingles_a") - F.col("place_a"), F.col("n_shingles_b") - F.col("place_b"))
    enough = (100 + threshold) * (behind + 1) >= threshold * (F.col("n_shingles_a") + F.col("n_shingles_b"))
    met = sides[0].join(sides[1], (sides[0]["hash"] == sides[1]["hash"]) & (F.col("root_a") < F.col("root_b"))
                        & _sizes_allow(threshold) & enough & _likely(threshold))
    pairs = stage(met.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct(), "near-pairs")
    drop_staged(first)
    return pairs


def numbered_classes(sig: DataFrame) -> DataFrame:
    """The stored ``(class, digest, key, n_shingles, bands, planes, odd)``: each distinct set once, under an 8-byte number."""
    distinct = sig.filter("digest IS NOT NULL AND key IS NOT NULL").select("digest", "key", *SIGNATURE, "bands").dropDuplicates(["digest"])
    return stage(distinct.withColumn("class", F.monotonically_increasing_id()), "near-classes")


def class_links(classed: DataFrame, one: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, threshold: int) -> DataFrame:
    """Components of classes, ``(node, root)`` for every class with a link; ``classed`` is ``(key, class)``."""
    classed = classed.filter("class IS NOT NULL AND key IS NOT NULL")
    # one key with several texts links their classes
    spread = classed.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a <> z").select("key", "a")
    links = stage(classed.join(spread, "key").filter("class <> a").select("a", F.col("class").alias("b")).distinct(), "near-links")
    level = stage(_shared_buckets(one.select("class", F.explode("bands").alias("bucket"))), "near-buckets")
    wanted = stage(level.select("class").distinct().join(one.select("class", "digest", "key"), "class"), "near-wanted")
    found = reduced(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", wanted, "key").join(wanted, "key")
    texts = stage(_of_class(found.select("class", "digest", "text"), shingle).dropDuplicates(["class"]), "near-texts")
    drop_staged(wanted)
    tried = _likely_pairs(_star_pairs(level).unionByName(_dealt_pairs(level)).distinct(), one, threshold)
    links = _with_links(links, _confirmed(tried, texts, shingle, threshold))
    labels = stage(_components(links), "near-labels")
    opened = _opened(level, labels)
    drop_staged(level)
    rare = _rare_pairs(opened.filter(F.col("members") > SMALL), one, texts, shingle, threshold)
    near = _open_pairs(opened.filter(F.col("members") <= SMALL), one, threshold)
    pairs = stage(near.unionByName(rare).distinct().join(tried, ["a", "b"], "left_anti"), "near-pairs")
    drop_staged(opened), drop_staged(rare), drop_staged(tried)
    if not pairs.isEmpty():
        links = _with_links(links, _confirmed(pairs, texts, shingle, threshold))
        drop_staged(labels)
        labels = stage(_components(links), "near-labels")
    drop_staged(pairs), drop_staged(texts), drop_staged(links)
    return labels


def _with_links(links: DataFrame, more: DataFrame) -> DataFrame:
    """The stored links of both tables; the first, a stored one, goes."""
    both = stage(links.unionByName(more), "near-links")
    drop_staged(links)
    return both


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    threshold: int = THRESHOLD) -> DataFrame:
    """``(key, n_shingles, component, kept)`` per document; ``component`` is the smallest key that links reach."""
    sig = stage(signatures(docs, key, text, shingle).withColumnRenamed("class", "digest"), "near-signatures")
    one = numbered_classes(sig)
    classed = stage(sig.select("key", "n_shingles", "digest").join(
        one.select("digest", "class"), "digest", "left").select("key", "n_shingles", "class"), "near-classed")
    drop_staged(sig)
    labels = class_links(classed.select("key", "class"), one, docs, key, text, shingle, threshold)
    drop_staged(one)
    rooted = _labelled(classed, labels, "class", "root")
    smallest = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("component"))
    alike = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    joined = rooted.join(smallest, "root", "left").select("key", "n_shingles", alike.alias("component"))
    return joined.withColumn("kept", F.coalesce(F.col("key") == F.col("component"), F.lit(True)))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest key; of rows with one key one stays."""
    found = stage(near_duplicates(docs, key, text, shingle, threshold), "near-components")
    gone = found.filter("NOT kept").select("key")
    again = stage(found.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "near-repeats")
    rows = without(docs, key, gone.unionByName(again), "key")
    if again.isEmpty():
        return rows
    single = without(docs.join(again.select(F.col("key").alias(key)), key, "left_semi").select(*docs.columns), key, gone, "key")
    return rows.unionByName(single.dropDuplicates([key]))
