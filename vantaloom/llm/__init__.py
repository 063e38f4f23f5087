"""Operators of a training-data pipeline, their queries and their SQL.

Nothing outside this subpackage imports it.
"""
