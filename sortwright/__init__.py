"""Spark-first engine for sorting, key analysis and training-data work."""
