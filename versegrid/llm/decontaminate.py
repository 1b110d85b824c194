"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text is its words in order. Of every window of ``span`` words, the smallest hash of
the ``NGRAM``-word runs inside it is kept; equal windows keep equal hashes, so two texts
that share ``span`` words in a row share a kept hash, wherever it stands. Kept hashes of
documents and benchmark items are joined, and around each meeting the windows that
contain it are compared word by word. Hashes only propose; words decide.

Hashes of documents are never grouped. The item side is stored first, so its size is
known when Spark picks the join; beyond the broadcast limit both sides shuffle by hash
and AQE splits frequent ones. The texts that met an item are fetched behind a bit map of
their digests, so a clean text is not shuffled. Copies of one text are looked at once, by their digest.

Defined cases: a null text, or one without words, has no window and is never hit; a
null item has no window either. An item of fewer than ``span`` words is one window of
its own length. Items of equal words all count, under each of their ids; a null item
id is listed as the empty string. Repeated documents each get their row. Empty tables
give no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from versegrid.llm.common import fresh, in_order, let, lower_ascii, reduced
from versegrid.session import stage

SPAN = 13
NGRAM = 5
#: Words after lower-casing A-Z: runs of digits, small letters and anything outside
#: ASCII. Java finds these ranges several times faster than the complement of the others.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
#: The same words before lower-casing, for counting.
RAW_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
#: A kept hash has its word position in the low bits; an array cannot have more elements than these can count.
PLACE_BITS = 28
PLACE_MASK = (1 << PLACE_BITS) - 1


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).cast("long")


def winnowed(tokens: Column, span: int, ngram: int = NGRAM) -> Column:
    """Kept hashes of a word array, each above its position; of equal ones in a window the last is kept."""
    ngram = min(ngram, span)

    def run_hash(i: Column) -> Column:
        value = F.xxhash64(*[F.get(tokens, i + j) for j in range(ngram)])
        return value.bitwiseAND(F.lit(~PLACE_MASK)).bitwiseOR(F.lit(PLACE_MASK) - i.cast("long"))

    def smallest(runs: Column, i: Column) -> Column:
        inside = [F.get(runs, i + j) for j in range(span - ngram + 1)]
        return F.least(*inside) if len(inside) > 1 else inside[0]

    return let(F.transform(in_order(F.size(tokens) - ngram), run_hash), lambda runs: F.array_distinct(
        F.transform(in_order(F.size(tokens) - span), lambda i: smallest(runs, i))))


def _fingerprints(df: DataFrame, key: str, tokens: Column, spans: list[int]) -> DataFrame:
    """``(key, span, hash, place)`` with one row per kept hash."""
    def of_span(own: Column, span: int) -> Column:
        return F.transform(winnowed(own, span), lambda v: F.struct(F.lit(span).alias("span"), v.alias("v")))

    def marked(own: Column) -> Column:
        return F.concat(*[of_span(own, s) for s in spans])

    kept = df.select(key, F.explode(let(tokens, marked)).alias("f"))
    return kept.select(key, "f.span", F.shiftright("f.v", PLACE_BITS).alias("hash"),
                       (F.lit(PLACE_MASK) - F.col("f.v").bitwiseAND(F.lit(PLACE_MASK))).cast("int").alias("place"))


def _equal_windows(own: Column, item: Column, place: Column, item_place: Column, span: Column) -> Column:
    """First word numbers of the windows around a meeting that are equal word for word."""
    shift = place - item_place
    low = F.greatest(place - span + 1, shift, F.lit(0))
    high = F.least(place, F.size(own) - span, shift + F.size(item) - span)
    starts = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda s: F.slice(own, s + 1, span) == F.slice(item, s - shift + 1, span))


def shared_windows(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
                   span: int = SPAN) -> DataFrame:
    """``(digest, item, start, stop)``: words of a text that are a window of an item.

    ``digest`` is the md5 of the document's text and ``item`` that of the item's words.
    """
    item_words = items.select(words(F.col(item_text)).alias("item_words")).filter(F.size("item_words") > 0)
    item_words = stage(item_words.withColumn("item", F.md5(F.array_join("item_words", " "))).dropDuplicates(["item"])
                       .withColumn("item_span", F.least(F.size("item_words"), F.lit(span))), "bench-items")
    spans = sorted(r[0] for r in item_words.select("item_span").distinct().collect())  # at most ``span`` numbers
    texts = docs.filter(F.col(text).isNotNull()).select(F.md5(text).alias("digest"), F.col(text).alias("text"))
    if not spans:
        return texts.limit(0).select("digest", F.lit("").alias("item"), F.lit(0).alias("start"), F.lit(0).alias("stop"))
    item_marks = stage(_fingerprints(item_words, "item", F.col("item_words"), spans).join(
        item_words.select("item", F.col("item_span").alias("span")), ["item", "span"]).withColumnRenamed(
        "place", "item_place"), "bench-marks")
    doc_marks = _fingerprints(texts, "digest", words(F.col("text")), spans)
    met = stage(doc_marks.join(item_marks, ["span", "hash"]).select(
        "digest", "item", "span", "place", "item_place").distinct(), "bench-meetings")
    hit = met.select("digest").distinct()
    wanted = reduced(texts, "digest", hit, "digest").join(hit, "digest").dropDuplicates(["digest"]).select(
        "digest", words(F.col("text")).alias("own"))
    both = met.join(wanted, "digest").join(item_words.select("item", "item_words"), "item")
    starts = _equal_windows(F.col("own"), F.col("item_words"), F.col("place"), F.col("item_place"), F.col("span"))
    return both.select("digest", "item", "span", F.explode(starts).alias("start")).distinct().select(
        "digest", "item", "start", (F.col("start") + F.col("span")).alias("stop"))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", span: int = SPAN, name: str = "found") -> DataFrame:
    """``docs`` with a struct ``name`` of n_words, n_hit, n_items, items_sha256 and contaminated.

    A column of that name is replaced.
    """
    windows = stage(shared_windows(docs, items, text, item_text, span), "bench-windows")
    # words inside any window: each window adds what reaches beyond those before it
    before = W.partitionBy("digest").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0)))
    hit = windows.select("digest", "start", "stop").distinct().withColumn(
        "new", F.greatest(F.col("stop") - reach, F.lit(0))).groupBy("digest").agg(F.sum("new").alias("n_hit"))
    ids = items.select(F.md5(F.array_join(words(F.col(item_text)), " ")).alias("item"),
                       F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id")).distinct()
    listed = windows.select("digest", "item").distinct().join(ids, "item").groupBy("digest").agg(
        F.array_sort(F.collect_set("id")).alias("ids"))
    by_text = stage(hit.join(listed, "digest"), "bench-texts")
    digest = fresh(docs, "digest")
    rows = docs.withColumn(digest, F.md5(F.col(text)))
    joined = rows.join(by_text.withColumnsRenamed({"digest": f"{digest}_2", "n_hit": f"{digest}_hit", "ids": f"{digest}_ids"}),
                       F.col(digest) == F.col(f"{digest}_2"), "left")
    n, n_hit = word_count(F.col(text)), F.coalesce(F.col(f"{digest}_hit"), F.lit(0)).cast("long")
    listed_ids = F.coalesce(F.col(f"{digest}_ids"), F.array().cast("array<string>"))
    found = F.struct(
        n.alias("n_words"), n_hit.alias("n_hit"), F.size(listed_ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed_ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= n)).alias("contaminated"))
    return joined.withColumn(name, found).drop(digest, f"{digest}_2", f"{digest}_hit", f"{digest}_ids")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones."""
    name = fresh(docs, "found")
    return contamination(docs, items, name=name, **options).filter(~F.col(name)["contaminated"]).drop(name)
