"""Structured Streaming forms of the as-of operators."""
