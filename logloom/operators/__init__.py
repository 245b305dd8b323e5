"""Grouping, profiling, matching and metrics over DataFrames."""
