"""Relational operators on rows, keys and values."""
