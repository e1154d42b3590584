"""Word counts over lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .basics import top_k


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no (from 0), line: documents split at newlines."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def cleaned(lines: DataFrame, col: str = "line") -> DataFrame:
    return lines.withColumn(col, T.clean_line(F.col(col)))


def words_of(lines: DataFrame, col: str = "line") -> DataFrame:
    """Column word: the words of cleaned lines."""
    return lines.select(F.explode(T.words(T.clean_line(F.col(col)))).alias("word"))


def word_count(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n"))


def unique_words(words: DataFrame) -> DataFrame:
    """One row, n_unique. Distinct words are made before they are counted: no set of words meets in one task."""
    return words.distinct().agg(F.count("*").alias("n_unique"))


def mean_count(words: DataFrame) -> DataFrame:
    """One row, mean_count: occurrences for each distinct word, to two places (null without words)."""
    return word_count(words).agg(F.round(F.sum("n") / F.count("*"), 2).alias("mean_count"))


def total_words(words: DataFrame) -> DataFrame:
    return words.agg(F.count("*").alias("n_words"))


def upper_words(words: DataFrame) -> DataFrame:
    return words.select("word", T.upper(F.col("word")).alias("word_upper"))


def word_lengths(words: DataFrame) -> DataFrame:
    return words.select("word", F.length("word").cast("bigint").alias("n_chars"))


def top_words(words: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent words; of equals the first in the alphabet."""
    return top_k(word_count(words), k, F.desc("n"), "word")


def last_words(words: DataFrame, k: int = 5) -> DataFrame:
    """The k last words in natural order, repeats included."""
    return top_k(words, k, F.desc("word"))
