"""Generic operators: numeric checks, top-k, unions, numbering, rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir


def range_sum(spark: SparkSession, n: int = 100_000, divisor: int = 1) -> DataFrame:
    """Sum of the multiples of divisor below n: one row, total."""
    return spark.range(n).where(F.col("id") % divisor == 0).agg(F.sum("id").alias("total"))


def top_k(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first k rows of an order, which must be total for the result to be fixed. Each task keeps k rows, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)


def concat(*frames: DataFrame) -> DataFrame:
    """All rows of frames that share their columns' names."""
    return reduce(DataFrame.unionByName, frames)


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def numbered(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Rows with their place in an order, from 0, over all partitions.

    Rows are sorted by range, numbered inside their partition, and moved up by the sizes of the partitions before (one row a partition is all that
    meets in one task). The sorted rows are written to the shared scratch folder with their partitions' numbers, as both passes must see the same ones.
    """
    path = scratch_dir(df.sparkSession)
    df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(offsets), part == F.col("_part"))
    return out.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_n", "_before")


def rounds(df: DataFrame, n: int, *keys: str) -> list[DataFrame]:
    """The rows in n parts by a hash of their keys (of all columns without keys); no row is left over."""
    part = F.pmod(F.xxhash64(*(keys or df.columns)), F.lit(n))
    return [df.where(part == i) for i in range(n)]


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Each row's part of the sum of value over all rows; the sum is a scalar subquery."""
    return df.withColumn(name, F.col(value) / df.agg(F.sum(value)).scalar())


def dealt(df: DataFrame, partitions: int, *keys: str, by_range: bool = False) -> DataFrame:
    """Rows dealt to partitions by a hash of their keys, or by sampled ranges of them; every value has a place, nulls too."""
    if not keys:
        return df.repartition(partitions)
    return df.repartitionByRange(partitions, *keys) if by_range else df.repartition(partitions, *keys)
