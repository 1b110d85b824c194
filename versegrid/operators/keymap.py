"""Rows without most of those that a join would drop, by a bit map of the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of the map in :func:`reduced`: 256 rows of 4 KB.
MAP_BITS = 1 << 23


def _map_marked(rows: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``rows`` and the name of a new column: whether the bit of ``column`` is set in a map of the keys.

    The size of the map is fixed at 1 MB, which is what bounds its broadcast.
    """
    def bit(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(MAP_BITS))

    block, place, bits, is_set = (fresh(rows, f"map_{n}") for n in ("block", "place", "bits", "set"))
    marks = keys.select(F.shiftright(bit(key), 15).alias(block), bit(key).bitwiseAND(F.lit(32767)).alias("p")).groupBy(block).agg(
        F.bitmap_construct_agg("p").alias(bits))
    placed = rows.withColumns({block: F.shiftright(bit(column), 15), place: bit(column).bitwiseAND(F.lit(32767)).cast("int")})
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.expr(f"1 << ({place} & 7)").bitwiseAND(byte) != 0, F.lit(False))
    return placed.join(F.broadcast(marks), block, "left").withColumn(is_set, found).select(*rows.columns, is_set), is_set


def reduced(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among ``keys``, so that a later join moves less.

    Rows whose bit is set stay, by chance also some that match no key; with far more
    keys than bits all rows stay. No row with a key in ``keys`` goes.
    """
    marked, is_set = _map_marked(rows, column, keys, key)
    return marked.filter(is_set).drop(is_set)


def without(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``column`` is not among ``keys``; only rows that the bit map cannot clear are joined with them."""
    marked, is_set = _map_marked(rows, column, keys, key)
    clear = marked.filter(~F.col(is_set)).drop(is_set)
    # an outer join, as Spark would move an anti join below the bit map
    named = keys.select(F.col(key).alias(is_set)).filter(F.col(is_set).isNotNull()).distinct()
    unsure = reduced(rows, column, keys, key)
    stay = unsure.join(named, unsure[column] == named[is_set], "left").filter(F.col(is_set).isNull()).drop(is_set)
    return clear.unionByName(stay)
