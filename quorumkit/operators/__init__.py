"""Operators on sets of samples: traces, similarity, clusters, uncertainty, evaluation, selection."""
