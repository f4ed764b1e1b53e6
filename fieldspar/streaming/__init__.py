"""Structured Streaming jobs (extensions)."""
