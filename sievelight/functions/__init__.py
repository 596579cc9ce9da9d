"""Functions of the contamination engine."""
