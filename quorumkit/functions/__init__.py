"""Column functions on text, JSON and code."""
