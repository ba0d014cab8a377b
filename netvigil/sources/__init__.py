"""sources of the telemetry engine."""
