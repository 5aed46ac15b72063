"""Operators on telemetry, zones, cycles, models, events and status tables."""
