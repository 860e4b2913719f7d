"""Column functions: paths, text lines, vectors, embedding."""
