"""Spark-native scoring, evaluation and preparation of text corpora."""
