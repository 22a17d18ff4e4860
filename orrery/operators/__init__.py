"""Operators on frames (rows) and features (columns)."""
