"""Streaming of the contamination engine."""
