"""Whole runs: from saved samples to results."""
