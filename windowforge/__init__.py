"""Spark operators for aligning, screening, splitting and judging labelled windows, on DataFrames throughout."""
