"""Exact row numbers over a whole table without one global task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from versegrid.session import stage


def global_row_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3 … in the order of ``order``, which should be unique.

    Rows are range-partitioned by ``order`` and stored with their partition number,
    so the sampled bounds are drawn once. Each partition is then numbered on its
    own and shifted by the size of those before it. The shift table has one row
    per partition, which bounds both its window and its broadcast.
    """
    ranged = stage(
        df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()),
        "ranged",
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy("_range").orderBy(*order)
    numbered = ranged.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(F.broadcast(shifts), "_range")
        .withColumn(name, (F.col("_inside") + F.col("_shift")).cast("long"))
        .drop("_range", "_inside", "_shift")
    )
