"""Incremental versions of the record operators (Structured Streaming)."""
