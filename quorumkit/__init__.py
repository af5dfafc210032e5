"""A Spark-first engine for sets of generated program samples: clustering, uncertainty, evaluation, selection."""
