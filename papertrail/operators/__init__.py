"""Relational operators: observation tables in, DataFrames out."""
