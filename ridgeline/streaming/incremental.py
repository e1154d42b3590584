"""Incremental versions: files arrive in rounds, each round is joined and added to running results, and the last result is returned.

Rounds are micro-batches over files (``files`` of them at a time); the engine ends when all files are read, so nothing is left over and no deadline cuts a result
short. Partial results, running state and results lie in the shared scratch folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import star
from ..operators import wordcount as W
from ..session import scratch_dir


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, ``files`` a round, whether the table is a folder of files or a single one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def _follow(query: StreamingQuery, on_progress: Callable[[dict], None] | None) -> None:
    """Waits for the end of a query; on_progress gets the report of each round as it comes, each once, in order."""
    last = -1
    while True:
        ended = query.awaitTermination(0.2)
        for report in query.recentProgress if on_progress else ():
            report = report if isinstance(report, dict) else json.loads(report.json)
            if report["batchId"] > last:
                last = report["batchId"]
                on_progress(report)
        if ended:
            return


def run_to_end(result: DataFrame, on_progress: Callable[[dict], None] | None = None) -> DataFrame:
    """Runs a streaming aggregation over all that is there; its last complete result. Every round writes the whole result so far: for small results."""
    spark = result.sparkSession
    out = scratch_dir(spark)
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{out}/result-{number}"
        batch.write.mode("overwrite").parquet(path)
        last.append(path)

    query = result.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    _follow(query, on_progress)
    if not last:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(last[-1])


def run_in_rounds(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], total: Callable[[DataFrame], DataFrame], on_progress: Callable[[dict], None] | None = None) -> DataFrame:
    """What ``total`` makes of the ``partial`` results of all rounds.

    Each round writes its own partial result, and no more, into a folder of its number, which a repeated round overwrites; they are added up once, at the end.
    """
    spark = stream.sparkSession
    out = scratch_dir(spark)
    schema = partial(spark.createDataFrame([], stream.schema)).schema

    def keep(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/rounds/round={number}")

    query = stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    _follow(query, on_progress)
    if query.lastProgress is None:
        return total(spark.createDataFrame([], schema))
    return total(spark.read.schema(schema).parquet(f"{out}/rounds").select(*schema.names))


def word_count(docs: DataFrame, on_progress: Callable[[dict], None] | None = None) -> DataFrame:
    """word, n over a stream of documents."""
    return run_in_rounds(docs, lambda d: W.word_count(W.words_of(W.lines_of(d))), lambda p: p.groupBy("word").agg(F.sum("n").alias("n")), on_progress)


def multi_source_orders(sales: DataFrame, shipped: DataFrame, returns: DataFrame, dates: DataFrame, addresses: DataFrame, centers: DataFrame, p: star.MultiSource = star.MultiSource(), on_progress: Callable[[dict], None] | None = None) -> DataFrame:
    """The totals of ``star.multi_source_orders`` over a stream of sales.

    Dimensions, returns and the orders with several warehouses (of ``shipped``: order, warehouse) are static sides; those by order are built once, before the first round. Each round
    is joined to them and summed by order, and the totals are taken from these sums when the stream has ended.
    """
    spark = sales.sparkSession

    def built(df: DataFrame) -> DataFrame:
        path = scratch_dir(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    days = dates.where(p.in_range(F.col("day"))).select("date_key").distinct()
    here = addresses.where(F.col("state") == p.state).select("address_key").distinct()
    there = centers.where(F.col("county").isin(*sorted(set(p.counties)))).select("center_key").distinct()
    # orders that count: several warehouses, never returned
    good = built(star.several(shipped).join(returns.select("order").distinct(), "order", "left_anti"))

    def partial(rows: DataFrame) -> DataFrame:
        rows = rows.where("warehouse is not null").join(days, "date_key", "left_semi").join(here, "address_key", "left_semi").join(there, "center_key", "left_semi").join(good, "order", "left_semi")
        return rows.groupBy("order").agg(F.sum("ship_cost").alias("ship_cost"), F.sum("profit").alias("profit"))

    return run_in_rounds(sales, partial, star.summed, on_progress)
