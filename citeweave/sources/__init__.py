"""Sources of the citation engine."""
