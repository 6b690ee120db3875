"""functions of the isthmus engine."""
