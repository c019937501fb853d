"""Operators for large-scale training-data pipelines, and their queries."""
