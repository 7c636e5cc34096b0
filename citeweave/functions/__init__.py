"""Functions of the citation engine."""
