"""Streaming forms of log operators."""
