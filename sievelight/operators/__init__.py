"""Operators of the contamination engine."""
