"""Sinks: delimited files, the console, metrics as JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "error") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).csv(path)


def show(df: DataFrame, rows: int = 20, plan: bool = False) -> None:
    df.show(rows, truncate=False)
    if plan:
        df.explain("formatted")


def write_metrics(spark, metrics: list[dict], path: str) -> None:
    """Measurements as JSON lines, through Spark's writer: any store it can write to will do."""
    rows = [(json.dumps(m, sort_keys=True, default=str),) for m in metrics]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(path)
