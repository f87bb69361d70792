"""Incremental index builds with Structured Streaming."""
