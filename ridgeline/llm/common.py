"""What the operators share: tables, scratch tables in the cluster's shared folder, and word splitting."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import scratch_dir

#: Words are runs of anything but the six ASCII white-space characters; bytes.split() splits alike.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for f in df.inputFiles()[:1]:
        parent = jvm.org.apache.hadoop.fs.Path(f).getParent()
        parent.getFileSystem(conf).delete(parent, True)


def nested(df: DataFrame) -> DataFrame:
    """df as the one struct column row: no name that an operator adds beside it can clash with the caller's. ``select("row.*")`` gives df back."""
    return df.select(F.struct("*").alias("row"))


def field(name: str) -> Column:
    """A column of the caller's in a nested table."""
    return F.col("row").getField(name)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


_sent: list[Broadcast] = []


def broadcast(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast variable. Executors drop their copies of those sent before; a query that still needs one fetches it anew."""
    for old in _sent:
        old.unpersist()
    _sent[:] = [spark.sparkContext.broadcast(value)]
    return _sent[0]


def count_words(text: Column) -> Column:
    """Words of a text as long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def sketch_parts(spark: SparkSession) -> int:
    """Partitions for a hash exchange of the operators' own: the session's setting, which the cluster sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of text for which a hash exchange gets a slice of its own, at least.
SLICE_TEXT = 64 << 20


def slice_count(docs: DataFrame, text_col: str) -> int:
    """Slices for an exchange of what the texts hold: the session's partitions, or more where the texts ask for more. Reads the lengths of all texts."""
    n = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(sketch_parts(docs.sparkSession), -(-n // SLICE_TEXT))


def slices(texts, limit: int = 8 << 20):
    """Parts of an Arrow string array of at most about ``limit`` bytes, one row at least; nulls become empty texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield texts.slice(first, last - first)
        first = last
    pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took


def struct_rows(columns, fields):
    """A struct array from columns (lists or arrays) and (name, Arrow type) pairs."""
    import pyarrow as pa

    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


#: What empties the caches that modules keep in a worker, by module.
_caches: dict[str, Callable[[], None]] = {}


def keeps_cache(owner: str, empty: Callable[[], None]) -> None:
    """Has ``empty`` called when another operator's task begins in this worker, and when such a task ends."""
    _caches[owner] = empty


def tidy(owner: str | None = None) -> None:
    """Gives memory that nothing uses back to the system, and empties all caches but the owner's: workers outlive stages."""
    import pyarrow as pa

    for name, empty in _caches.items():
        if name != owner:
            empty()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidied(run: Callable, owner: str | None = None) -> Callable:
    """A worker's function over batches that tidies up before its first batch and after its last."""

    def whole(batches: Iterator) -> Iterator:
        tidy(owner)
        try:
            yield from run(batches)
        finally:
            tidy(owner)

    return whole


def arrow_function(run, kind: str, owner: str | None = None):
    """An Arrow function over batches of one text column, evaluated once a row."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    whole = tidied(run, owner)
    whole.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(kind)(whole).asNondeterministic()
