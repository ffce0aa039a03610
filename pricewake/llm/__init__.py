"""Operators for preparing training data, each usable on any table of texts or vectors."""
