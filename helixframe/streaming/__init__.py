"""Reads that arrive as a stream."""
