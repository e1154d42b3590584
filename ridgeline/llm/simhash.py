"""SimHash near-duplicates: pigeonhole blocks.

A text's fingerprint has a bit set if over half of its 3-word shingles' XXH64 values have it set. Fingerprints at most ``DISTANCE`` bits apart are linked. 64 bits are
split into ``BLOCKS`` blocks; a close pair agrees on at least BLOCKS - DISTANCE of them, so fingerprints are joined on every choice of that many blocks (38 bits or more)
and pairs are verified by their Hamming distance.

Equal fingerprints are one from the start, so copies make no pairs. A block that more than ``HOT`` fingerprints share isn't paired up: its fingerprints are
listed under all values one bit away and under their own; two that are at most two bits apart meet under such a value, and all that meet
under one value (65 at most) are at most two bits apart, so a star under each value links them with 65 rows a fingerprint and no pairs.

Defined results: a text of fewer than three words is one shingle; texts without words and nulls have fingerprint zero and are
linked like any other; a null id never names a group unless all its ids are null; repeated rows get equal results; of rows that tie for least id
the one of least fingerprint and text hash stays; a very long text is hashed in parts of 65,536 shingles; an empty table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_function, field, materialize, nested, slices
from .components import components

DISTANCE, BLOCKS, HOT = 2, 5, 16
SEED = 42


def shingles(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if len(words) < 3:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(words, words[1:], words[2:])))


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprints as uint64."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        own = shingles(t)
        counts[i] = len(own)
        hashes.extend(map(xxhash.xxh64_intdigest, own, repeat(SEED)))
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        ends = np.cumsum(counts[some])
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        totals = np.zeros((len(some), 64), dtype=np.int64)
        starts = ends - counts[some]
        for a in range(0, len(raw), 1 << 16):  # so many shingles' bits at a time
            bits = np.unpackbits(raw[a : a + (1 << 16)], axis=1, bitorder="little")
            first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, a + len(bits), side="left")
            cuts = np.maximum(starts[first:last] - a, 0)
            totals[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        majority = (2 * totals > counts[some, None]).astype(np.uint8)
        out[some] = np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprint() -> object:
    """An Arrow function of a text column: the fingerprint as a signed long."""
    import pyarrow as pa

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [fingerprints(part.to_pylist()).view(np.int64) for part in slices(batch, 1 << 20)]
            yield pa.array(np.concatenate(parts) if parts else [], type=pa.int64())

    return arrow_function(run, "bigint")


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each choice of blocks - distance blocks, the bits in them, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    out = [sum(choice) for choice in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(prints: DataFrame) -> DataFrame:
    """u, v: linked pairs of the distinct fingerprints in column fp; in hot blocks stars that link the same ones."""
    choices = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks())])
    blocks = prints.select("fp", F.inline(choices))
    shared = blocks.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    blocks = materialize(blocks.join(shared, ["c", "k"]))
    cool = blocks.where(F.col("n") <= HOT)
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= DISTANCE
    pairs = cool.alias("a").join(cool.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & near)
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    hot = blocks.where(F.col("n") > HOT).select("fp").distinct()
    flips = [0, *((1 << i) - (1 << 64) * (i == 63) for i in range(64))]
    around = hot.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("fp").bitwiseXOR(x))).alias("value"))
    met = around.groupBy("value").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    stars = met.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u != v")
    return pairs.unionAll(stars).distinct()


def grouped(prints: DataFrame) -> DataFrame:
    """prints (id, fp; a row for each document) with component_id, the least id that can be reached over links."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp")))
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of = materialize(of)
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(names, "root").select("fp", "component_id"), "fp")


def prints_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash and fp of each row."""
    text = F.col(text_col)
    return materialize(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), fingerprint()(text).alias("fp")))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    g = grouped(prints_of(docs, id_col, text_col))
    return g.select(F.col("id").alias(id_col), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group the one of least id (then least fingerprint, then least hash of its text), a repeated row once.

    Rows are found again by id and hash of the text, so a text is fingerprinted once. Both sides of the join are dealt by these two keys, which the removal of repeated rows uses again.
    """
    g = grouped(prints_of(docs, id_col, text_col))
    stay = g.groupBy("component_id").agg(F.min(F.struct("id", "fp", "text_hash")).alias("s"))
    # a null id has a key of its own, so that keys are never null
    key = lambda c: F.coalesce(F.concat(F.lit("i"), c.cast("string")), F.lit("n"))
    stay = stay.select(key(F.col("s.id")).alias("id_key"), F.col("s.text_hash").alias("text_key")).distinct()
    rows = nested(docs)
    rows = rows.withColumns({"id_key": key(field(id_col)), "text_key": F.xxhash64(F.coalesce(field(text_col), F.lit("")))})
    return rows.join(stay, ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"]).select("row.*")
