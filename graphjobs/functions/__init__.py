"""Column and vector helpers."""
