"""Operators: each takes and returns DataFrames; windows, cut-offs and sizes are arguments."""
