"""Operators on DataFrames and columns."""
