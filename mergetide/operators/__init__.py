"""Summaries as Spark plans: build, merge, ask."""
