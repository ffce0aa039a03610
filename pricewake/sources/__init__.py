"""Readers, snapshots and the sample-table mapping."""
