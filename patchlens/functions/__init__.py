"""Column helpers: each takes and returns ``Column`` objects."""
