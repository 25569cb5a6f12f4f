"""Structured Streaming queries over a live packet feed."""
