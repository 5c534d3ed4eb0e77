"""Structured Streaming sessions and incremental jobs."""
