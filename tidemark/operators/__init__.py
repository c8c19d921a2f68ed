"""Measurement operators: each a function from DataFrames (or Columns) to DataFrames (or Columns)."""
