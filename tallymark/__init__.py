"""Data-quality telemetry analytics on Spark: parse, score, roll up and forecast test results."""
