"""Training pairs and retrieval metrics for structured data, as Spark jobs."""
