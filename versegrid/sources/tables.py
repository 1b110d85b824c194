"""Schemas, scans and sinks of the tables that the jobs exchange."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

TRACKS = StructType([
    StructField("trackid", LongType()),
    StructField("url", StringType()),
    StructField("artist", StringType()),
    StructField("title", StringType()),
])
LYRICS = StructType([
    StructField("trackid", LongType()),
    StructField("lyrics", StringType()),
])
TAGS = StructType([
    StructField("trackid", LongType()),
    StructField("artist", StringType()),
    StructField("title", StringType()),
    StructField("tag", StringType()),
])
GENRES_JSON = "array<struct<genre:string,subgenres:array<string>>>"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A landed Parquet table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tsv(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Tab-separated text with a header and no quoting; several paths are united.

    Unquoted text has no null, so an empty text field is the empty string.
    """
    rows = spark.read.schema(schema).csv(
        path, sep="\t", header=True, quote="", escape="", encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return rows.na.fill("")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header and no quoting, one file per task.

    Unquoted fields cannot hold a tab, a line break or a NUL; a value with one fails
    the write instead of shifting columns. ``inline`` makes such values safe.
    """
    safe = {
        f.name: F.when(F.col(f.name).rlike("[\t\n\r\x00]"), F.raise_error(F.concat(
            F.lit(f"column {f.name} cannot be written as TSV: "), F.col(f.name)))).otherwise(F.col(f.name))
        for f in df.schema if f.dataType.simpleString() == "string"}
    df.withColumns(safe).write.csv(
        path, sep="\t", header=True, quote="", escape="", encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="",
    )


def read_genres(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, genre, subgenres)`` from one JSON array of objects; array order is kept.

    The list is a parameter of the tag job, a few kilobytes in a single file.
    """
    document = spark.read.text(path, wholetext=True)
    entries = document.select(F.posexplode(F.from_json("value", GENRES_JSON)).alias("ord", "g"))
    return entries.select("ord", "g.genre", "g.subgenres")


def write_genre_names(names: DataFrame, path: str) -> None:
    """Store ``(ord, genre, name)`` as JSON lines, one per name, written by all tasks."""
    names.select("ord", "genre", "name").write.json(path)


def read_genre_names(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, genre, name)`` from JSON lines, read in parallel; the form for lists of any size."""
    return spark.read.schema("ord int, genre string, name string").json(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """Dataset with a ``part`` column: one folder per part, read back with pruning."""
    df.write.partitionBy("part").parquet(path)


def read_dataset(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """All parts of a dataset, or only the files of one."""
    df = spark.read.parquet(path)
    return df if part is None else df.filter(F.col("part") == part)


def read_as_vectors(spark: SparkSession, path: str, column: str = "features") -> DataFrame:
    """Read ``struct<type,size,indices,values>`` files as ML vectors.

    That struct is the stored form of the vector type, so sparse vectors can be
    assembled by SQL functions and need no Python on the way.
    """
    stored = spark.read.parquet(path)
    fields = [StructField(f.name, VectorUDT() if f.name == column else f.dataType) for f in stored.schema]
    return spark.read.schema(StructType(fields)).parquet(path)


def write_reports(df: DataFrame, path: str) -> None:
    """Report rows of all learners, one folder per algorithm."""
    df.write.partitionBy("algorithm").parquet(path)


def union_shards(shards: list[DataFrame]) -> DataFrame:
    """Bag union of shards with equal columns; duplicates stay."""
    return reduce(DataFrame.unionByName, shards)
