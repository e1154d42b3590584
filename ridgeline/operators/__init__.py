"""Queries as functions of DataFrames."""
