"""Column functions on symbol sequences."""
