"""Event-timeline analytics as PySpark DataFrame, SQL and Structured Streaming operations."""
