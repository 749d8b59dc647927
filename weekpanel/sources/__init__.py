"""Readers, raw-record parsing, cleaning and sinks."""
