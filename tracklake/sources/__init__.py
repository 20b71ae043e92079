"""Readers, parsers and the views that bind operators to the test tables."""
