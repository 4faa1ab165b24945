"""Column functions: paths, text and regular expressions."""
