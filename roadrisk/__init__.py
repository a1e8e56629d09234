"""Usage-based motor-insurance analytics as Spark DataFrame, MLlib and Structured Streaming jobs."""
