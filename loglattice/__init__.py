"""Spark-native analytics over line-oriented logs and text corpora."""
