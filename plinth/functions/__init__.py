"""Column libraries: text, terms, statistics."""
