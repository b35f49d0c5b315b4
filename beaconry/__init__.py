"""Threat-intelligence analytics as PySpark DataFrame and Structured Streaming jobs."""
