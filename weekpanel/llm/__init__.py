"""Operators of a training-data pipeline on Spark; nothing outside this subpackage imports it."""
