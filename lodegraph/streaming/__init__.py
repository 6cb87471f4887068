"""Incremental versions of batch aggregates, on Structured Streaming."""
