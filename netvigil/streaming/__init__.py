"""streaming of the telemetry engine."""
