"""Plans of the citation engine."""
