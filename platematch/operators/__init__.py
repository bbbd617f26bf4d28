"""Operators over the cleaned domain tables: DataFrames in, DataFrame out."""
