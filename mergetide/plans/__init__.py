"""Execution patterns and the query catalogue."""
