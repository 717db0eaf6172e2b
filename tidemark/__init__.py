"""Spark-first analytics over activity logs."""
