"""Structured Streaming counterparts of the weekly operators."""
