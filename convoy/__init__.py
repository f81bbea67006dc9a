"""Convoy: fleet-telemetry analytics as PySpark DataFrame operators."""
