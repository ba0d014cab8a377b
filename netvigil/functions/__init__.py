"""functions of the telemetry engine."""
