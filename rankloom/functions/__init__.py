"""Column functions: text, vectors, formatting."""
