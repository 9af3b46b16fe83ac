"""Spark-native operators for building and judging multi-stage recommendation pipelines."""
