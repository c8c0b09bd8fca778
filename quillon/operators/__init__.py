"""Aggregates and orders over a selection."""
