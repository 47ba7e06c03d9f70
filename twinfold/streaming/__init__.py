"""Incremental clustering with Structured Streaming."""
