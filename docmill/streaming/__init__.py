"""Incremental forms of the jobs."""
