"""Column functions: text, facets, vectors, decisions."""
