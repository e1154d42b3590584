"""Readers and writers."""

from .readers import create_table, in_memory, read_delimited, read_lines, read_parquet_tables, register, repeated
from .sinks import show, write_csv, write_metrics

__all__ = ["create_table", "in_memory", "read_delimited", "read_lines", "read_parquet_tables", "register", "repeated", "show", "write_csv", "write_metrics"]
