"""Structured Streaming twins of the time-based operators."""
