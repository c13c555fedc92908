"""Summaries over event-time windows and as custom state."""
