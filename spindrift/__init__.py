"""Spark-first retrieval, landscape and event analytics over document corpora."""
