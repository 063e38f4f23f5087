"""Readers, sinks and staging of intermediate tables."""
