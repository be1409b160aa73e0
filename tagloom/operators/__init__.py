"""Relational operators of the library, each a function from DataFrames to DataFrames."""
