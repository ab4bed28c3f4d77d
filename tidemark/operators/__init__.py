"""Operators on DataFrames, one module per family."""
