"""Streaming of the citation engine."""
