"""Retrieval-data operations on Spark: pure DataFrame-to-DataFrame operators."""
