"""plans of the isthmus engine."""
