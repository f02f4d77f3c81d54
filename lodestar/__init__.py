"""Lodestar: retrieval, code-graph and corpus analytics as Spark DataFrame operators."""
