"""Versioned, logged and exported tables."""
