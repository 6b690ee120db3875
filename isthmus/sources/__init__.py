"""sources of the isthmus engine."""
