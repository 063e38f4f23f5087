"""Structured Streaming twins of the time-dependent operators."""
