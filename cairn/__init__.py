"""Batch retrieval, ingestion and measurement operators over documents, sessions and records, as Spark DataFrame transformations."""
