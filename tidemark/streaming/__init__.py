"""Structured Streaming forms of the series and event operators."""
