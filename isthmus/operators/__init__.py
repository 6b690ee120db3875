"""operators of the isthmus engine."""
