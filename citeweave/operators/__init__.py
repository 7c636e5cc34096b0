"""Operators of the citation engine."""
