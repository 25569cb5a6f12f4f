"""Network-capture analytics as Spark DataFrame and Structured Streaming functions."""
