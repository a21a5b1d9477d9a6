"""Spark jobs over stock lists and over training-data corpora."""
