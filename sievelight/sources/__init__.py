"""Sources of the contamination engine."""
