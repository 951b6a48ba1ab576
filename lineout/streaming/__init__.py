"""Scoring extracts as they arrive."""
