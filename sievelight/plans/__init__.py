"""Plans of the contamination engine."""
