"""operators of the telemetry engine."""
