"""Operators: every one takes DataFrames and column names and gives a DataFrame."""
