"""Operators on documents that arrive over time."""
