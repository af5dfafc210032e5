"""Structured Streaming over newly saved rounds."""
