"""Lanternfish: hybrid passage retrieval and corpus processing on Spark."""
