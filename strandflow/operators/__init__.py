"""Relational operators: each takes DataFrames with stated columns and returns a DataFrame, and runs alike on parsed programs and on tables."""
