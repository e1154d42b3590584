"""Incremental twins of the batch queries."""
