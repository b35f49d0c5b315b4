"""Operators for training-data pipelines: counts, filters, deduplication, mixing, scoring and output."""
