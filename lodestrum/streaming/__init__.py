"""Structured Streaming forms of the change and event operators."""
