"""Fund analytics on Spark: ingestion, reconciliation and text search over fund data."""
