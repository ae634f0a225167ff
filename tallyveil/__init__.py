"""Privacy-preserving telemetry analytics on Spark."""
