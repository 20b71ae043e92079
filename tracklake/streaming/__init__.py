"""Structured Streaming twins of the time-series operators."""
