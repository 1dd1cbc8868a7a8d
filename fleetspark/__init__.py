"""Spark jobs for fleet telemetry."""
