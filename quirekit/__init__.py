"""Spark-first analytics over recognised document text."""
