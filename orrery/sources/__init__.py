"""Sources and sinks: telemetry, registry, archive."""
