"""Operators: every function maps DataFrames to a DataFrame and runs fully distributed."""
