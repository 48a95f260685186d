"""Deliberately empty: the engine's data model has tables and no streams.

Queries return DataFrames, so callers can apply Structured Streaming to them
or to their sources; the engine adds no operator of its own.
"""
