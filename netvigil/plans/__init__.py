"""plans of the telemetry engine."""
