"""Spark-first engine that turns collections of long documents into structured knowledge tables."""
