"""Sinks: texts with their line endings, containers, the keyed index."""
