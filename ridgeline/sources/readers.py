"""Sources: rows in memory, text lines, delimited tables with declared schemas, Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..schemas import SCHEMAS


def in_memory(spark: SparkSession, rows: list, schema: str | StructType, partitions: int | None = None) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return df.repartition(partitions) if partitions else df


def read_lines(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """Column value, a row for each line. Files are split by the scan; ``partitions`` only deals them anew."""
    df = spark.read.text(path)
    return df.repartition(partitions) if partitions else df


def read_delimited(spark: SparkSession, path: str | list[str], table: str | None = None, schema: StructType | str | None = None, sep: str = "|", header: bool = False, null: str | None = None, suffix: str | None = None) -> DataFrame:
    """A delimited table with a declared schema. A delimiter at the line's end is read as nothing.

    header: whether files begin with a line of names (a header read as data, or data read as a header, loses or spoils a
    row, so it is never guessed). null: the token for NULL besides the empty one, "-" in some exports. suffix: only files whose names end so.
    """
    kind = schema or (SCHEMAS[table] if table else None)
    if kind is None:
        raise ValueError("a delimited source needs a schema or the name of a declared table")
    reader = spark.read.schema(kind).option("sep", sep).option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", True)
    if null is not None:
        reader = reader.option("nullValue", null)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.csv(path)


def create_table(spark: SparkSession, name: str, path: str, table: str | None = None, sep: str = "|", header: bool = False) -> DataFrame:
    """An external delimited table in the catalog, by DDL."""
    quoted = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMAS[table or name]}) USING csv OPTIONS (path '{quoted}', delimiter '{sep}', header '{str(header).lower()}')")
    return spark.table(name)


def read_parquet_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def repeated(df: DataFrame, times: int) -> DataFrame:
    """The rows so many times over: a larger input for measurements."""
    return reduce(DataFrame.unionAll, [df] * times) if times else df.limit(0)
