"""News feed analytics expressed as Spark DataFrame, MLlib and Structured Streaming jobs."""
