"""Operators: pure functions from DataFrames of reads, nodes and edges to DataFrames."""
