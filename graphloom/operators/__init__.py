"""Operators that Spark has no single primitive for."""
