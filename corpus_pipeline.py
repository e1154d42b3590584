"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Each stage works on all that its predecessor kept. All but the last return the columns of documents; the last returns a row for each document of the mix, copies included: doc_id and what encoding and decoding its text gave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm.common import materialize, table
from ridgeline.llm.mixing import mixed_documents
from ridgeline.llm.pieces import encoded
from ridgeline.llm.queries import piece_model
from ridgeline.llm.simhash import one_of_each
from ridgeline.llm.suffixes import deduplicated_documents
from ridgeline.llm.toxicity import clean_documents


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier flags by their language's threshold go."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays."""
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id holds too are cut out; no document goes."""
    return deduplicated_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the text decoded from them, as digests."""
    return encoded(docs, piece_model())


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A trained classifier and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
