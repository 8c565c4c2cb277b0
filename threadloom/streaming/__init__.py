"""Structured Streaming versions of the harvest."""
