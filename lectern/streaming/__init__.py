"""Structured Streaming versions of the running counts."""
