"""Cube tables, the views over them, and the query builders that compile to DataFrames."""
