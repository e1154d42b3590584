"""Lines of an access log in Common Log Format: patterns and parsed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two line formats. LENIENT takes blanks in the request, but leaves the protocol empty.
STRICT = r'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] "(\S+) (\S+)\s*(\S*)" (\d{3}) (\S+)'
LENIENT = r'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] "(\S+) (\S+)\s*.*(\S*)" (\d{3}) (\S+)'

MARK = "\x01"


def groups(line: Column, pattern: str = LENIENT) -> Column:
    """The nine groups of a line that matches, else null.

    The pattern runs once a line: a match is rewritten as its groups with a control character between them, which no log line
    holds (one that does counts as not matched).
    """
    rewritten = F.regexp_replace(line, pattern + r"[\s\S]*", MARK.join(f"${i}" for i in range(1, 10)))
    parts = F.split(rewritten, MARK)
    return F.when(~F.contains(line, F.lit(MARK)) & F.contains(rewritten, F.lit(MARK)), parts)


def time_of(found: Column) -> Column:
    """The time written in the line, without regard to the zone; null if it is none."""
    return F.try_to_timestamp(F.substring(F.get(found, F.lit(3)), 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz")


def size_of(found: Column) -> Column:
    """The size; 0 for "-", null for anything else that isn't a number."""
    size = F.get(found, F.lit(8))
    return F.when(size == "-", F.lit(0)).otherwise(size.try_cast("bigint")).cast("bigint")


def record(found: Column, time: Column, size: Column) -> Column:
    """The record's fields from groups, time and size."""
    names = ["host", "client_identd", "user_id", None, "method", "endpoint", "protocol"]
    fields = [time.alias("date_time") if n is None else F.get(found, F.lit(i)).alias(n) for i, n in enumerate(names)]
    return F.struct(*fields, F.get(found, F.lit(7)).try_cast("int").alias("response_code"), size.alias("content_size"))
