"""Column builders: null rules, rolling frames, text and array expressions."""
