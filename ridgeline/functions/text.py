"""Text: cleaning lines and splitting them into words. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_line(line: Column) -> Column:
    """Lower case, without any character but ASCII letters, digits and spaces, and without spaces at the ends.

    What is kept is extracted rather than the rest removed: matching the class itself is several times faster than matching its complement. Characters go
    before lower-casing, so the two others that turn into ASCII letters are replaced by hand: the Kelvin sign, and I with a dot (which becomes i and a combining dot).
    """
    kept = F.regexp_extract_all(F.translate(line, "\u212a\u0130", "ki"), F.lit("[a-zA-Z0-9 ]+"), F.lit(0))
    return F.trim(F.lower(F.array_join(kept, "")))


def words(line: Column) -> Column:
    """The words of a cleaned line; none for an empty or blank one."""
    return F.filter(F.split(line, " +"), lambda w: w != "")


def upper(word: Column) -> Column:
    return F.upper(word)


def percent_label(value: Column, least: float = 7.0) -> Column:
    """A chart's label: whole percent, nothing below ``least``."""
    return F.when(value < least, F.lit("")).otherwise(F.format_string("%.0f%%", value))
