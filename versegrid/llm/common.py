"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versegrid.operators.keymap import fresh, reduced, without

__all__ = ["WORD", "crc_mod", "fresh", "in_order", "let", "lower_ascii", "n_words", "reduced", "table", "unit_hash", "without"]
#: Words as runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z, every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(*parts: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the parts and the seed alone."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def in_order(last: Column) -> Column:
    """The array 0 .. ``last``, empty if ``last`` is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
