"""Incremental forms of landing and history, on Structured Streaming."""
