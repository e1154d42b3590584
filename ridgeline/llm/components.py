"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node reachable, for each node of an edge list u, v (longs; loops and repeats do no harm).

    A round hangs larger neighbours, then smaller ones, on the least neighbour of each node; the number of rounds grows with the
    logarithm of the longest path. Minima are aggregated before the shuffle; each round is written to the shared folder and the one before deleted.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    e = materialize(e)
    seen = _mark(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        drop_scratch(large)
        drop_scratch(e)
        e, now = small, _mark(small)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
