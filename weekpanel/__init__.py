"""Weekly-panel analytics on Spark: calendar-aligned features, as-of macro
joins, text events, regime sequences and strategy back-tests as DataFrame jobs."""

__version__ = "0.1.0"
