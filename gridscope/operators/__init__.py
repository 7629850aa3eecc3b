"""Relational operators: DataFrames in, DataFrames out; nothing is collected unless a docstring says so."""
