"""Operators on occurrence tables: DataFrames in, DataFrames out."""
