"""Spark-first evaluation analytics and corpus processing."""
