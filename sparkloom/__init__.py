"""Spark-first code-graph, retrieval, evaluation and telemetry analytics."""
