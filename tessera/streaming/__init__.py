"""Structured Streaming wrappers (additions: the reference has no streams)."""
