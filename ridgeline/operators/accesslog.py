"""Access-log analyses over parsed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import weblog as W
from .basics import count_by, share_of_total, top_k


def parse(lines: DataFrame, pattern: str = W.LENIENT, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """The records of the lines that can be read, and the lines that can't (column line): those that don't match, or whose time or size can't be read.

    Each step is a projection of its own and records come out of a generator, so that the pattern runs once a line: a filter on
    parsed fields isn't pushed below the parsing, where it would parse again.
    """
    found = lines.select(F.col(col).alias("line"), W.groups(F.col(col), pattern).alias("_found"))
    read = found.select("line", "_found", W.time_of(F.col("_found")).alias("_time"), W.size_of(F.col("_found")).alias("_size"))
    ok = F.col("_time").isNotNull() & F.col("_size").isNotNull()
    good = read.select(F.inline(F.when(ok, F.array(W.record(F.col("_found"), F.col("_time"), F.col("_size"))))))
    return good, read.where(~ok).select("line")


def size_stats(log: DataFrame) -> DataFrame:
    """One row: whole mean, least and largest size."""
    return log.agg(F.expr("sum(content_size) div count(*)").alias("mean_size"), F.min("content_size").alias("min_size"), F.max("content_size").alias("max_size"))


def status_counts(log: DataFrame) -> DataFrame:
    return count_by(log, "response_code")


def status_shares(log: DataFrame, least: float = 7.0) -> DataFrame:
    """Each status's part of all requests, and the label of its slice of a chart."""
    shares = share_of_total(status_counts(log), "n", "fraction")
    return shares.withColumn("label", T.percent_label(100 * F.col("fraction"), least))


def frequent_hosts(log: DataFrame, over: int = 10) -> DataFrame:
    return count_by(log, "host").where(F.col("n") > over)


def endpoint_counts(log: DataFrame) -> DataFrame:
    return count_by(log, "endpoint")


def top_endpoints(log: DataFrame, k: int = 10) -> DataFrame:
    return top_k(endpoint_counts(log), k, F.desc("n"), "endpoint")


def top_error_endpoints(log: DataFrame, k: int = 5) -> DataFrame:
    return top_endpoints(log.where("response_code != 200"), k)


def unique_hosts(log: DataFrame) -> DataFrame:
    return log.select("host").distinct().agg(F.count("*").alias("n_hosts"))


def _hour(log: DataFrame) -> DataFrame:
    return log.withColumn("hour", F.hour("date_time"))


def hourly_hosts(log: DataFrame) -> DataFrame:
    """Distinct hosts of each hour of the day."""
    return _hour(log).select("hour", "host").distinct().groupBy("hour").agg(F.count("*").alias("n_hosts"))


def hourly_requests_per_host(log: DataFrame) -> DataFrame:
    """Whole requests for each host and hour: both counts come from one pass, summed by (hour, host) first."""
    by = _hour(log).groupBy("hour", "host").agg(F.count("*").alias("n"))
    return by.groupBy("hour").agg(F.expr("sum(n) div count(*)").alias("requests_per_host"))


def not_found(log: DataFrame) -> DataFrame:
    return log.where("response_code = 404")


def not_found_count(log: DataFrame) -> DataFrame:
    return not_found(log).agg(F.count("*").alias("n_not_found"))


def not_found_endpoints(log: DataFrame, k: int = 30) -> DataFrame:
    """Up to k distinct endpoints that weren't found, in order of their names."""
    return top_k(not_found(log).select("endpoint").distinct(), k, "endpoint")


def top_not_found(log: DataFrame, k: int = 10) -> DataFrame:
    return top_endpoints(not_found(log), k)


def hourly_not_found(log: DataFrame) -> DataFrame:
    return _hour(not_found(log)).groupBy("hour").agg(F.count("*").alias("n"))
