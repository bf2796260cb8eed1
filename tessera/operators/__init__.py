"""Operators: DataFrames in, a DataFrame out; nothing is collected and no file system is probed."""
