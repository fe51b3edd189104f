"""Column expressions: labels, predictions, bins, grid places."""
