"""Incremental versions of the table jobs on Structured Streaming."""
