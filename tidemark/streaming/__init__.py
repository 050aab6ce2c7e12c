"""Structured Streaming forms of the features."""
