"""Spark-native document-knowledge analytics: ingestion, retrieval, routing, grounding and rollups."""
