"""Network-telemetry analytics on PySpark."""
