"""Incremental refresh of the daily series."""
