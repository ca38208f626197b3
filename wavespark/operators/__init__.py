"""Operators: DataFrames and literals in, a DataFrame out."""
