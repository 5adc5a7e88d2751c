"""A Spark-first engine for scoring read-depletion and filtering pipelines."""
